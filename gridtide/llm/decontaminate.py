"""Benchmark decontamination with a positional inverted index.

The index holds the postings (document, position, term) of the corpus for the terms that occur in the benchmark, and
for each document one posting of the empty-slot term at the position after its last word. Each benchmark window is
looked up from its rarest term on: the postings of the rarest term give candidate starts, those of the next terms,
shifted by their offset, are intersected with them one list after the other, and what is left is checked against the
postings of the remaining terms of the candidates' documents.

A reworded passage is found by proximity: of the ``RAREST`` rarest distinct terms of an item, ``SHARE`` in any order
within a stretch of text twice as long as the item, wherever it begins. Proximity is told beside the phrases (n_near)
and has no part in ``contaminated``.

Everything is a DataFrame expression. Cases: null and empty texts have no words; an item without words matches nothing;
repeated documents are judged row by row, repeated items count once by id (a null id counts as the empty string); equal
windows of several items are looked up once; empty tables give empty or clean results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.common import ASCII_LOWER, ASCII_UPPER, ascii_lower, broadcast_if_small, saved, table, without

WINDOW = 13
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = " "  # no word has a space
RAREST, SHARE = 8, 0.75
LISTS = 3  # lists intersected one by one before the rest is checked together
MOST = 2_000_000  # rows up to which a counted table is broadcast


def words(text):
    """The words of the lower-cased text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, phrase, length): size consecutive words, or all words of a shorter item."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.lit(size), F.size("w")))
    w = w.select("item_id", "w", "length", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("i"))
    return w.select("item_id", F.array_join(F.slice("w", F.col("i"), F.col("length")), " ").alias("phrase"), "length").distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index (row, doc_id, pos, term) of docs (doc_id, text) for terms (term)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(words(F.col("text")), F.array(F.lit(END))).alias("w"))
    own = terms.unionByName(terms.sparkSession.createDataFrame([(END,)], "term string")).distinct()
    return saved(rows.select("row", "doc_id", F.posexplode("w").alias("pos", "term")).join(broadcast_if_small(own, MOST), "term").select("row", "doc_id", "pos", "term"))


def frequencies(index: DataFrame) -> DataFrame:
    """(term, n): the number of postings; a row for each term of the benchmark that the corpus has."""
    return saved(index.groupBy("term").agg(F.count("*").alias("n")))


def ranked(phrases: DataFrame, n: DataFrame) -> DataFrame:
    """(phrase, length, rank, shift, term): the terms of each phrase from the rarest in the corpus on."""
    terms = phrases.select("phrase", "length", F.posexplode(F.split("phrase", " ")).alias("shift", "term")).join(broadcast_if_small(n, MOST), "term", "left")
    order = Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "shift")
    return saved(terms.select("phrase", "length", "shift", "term", F.row_number().over(order).alias("rank")))


def occurrences(index: DataFrame, phrases: DataFrame, n: DataFrame) -> DataFrame:
    """(row, start, phrase, length) of every occurrence of phrases (phrase, length) in the index; n: its frequencies."""
    probes = ranked(phrases, n)
    found = done = None
    for rank in range(1, LISTS + 1):
        own = broadcast_if_small(probes.where(F.col("rank") == rank).select("phrase", "length", "shift", "term"), MOST)
        if found is None:
            found = index.join(own, "term").select("row", (F.col("pos") - F.col("shift")).alias("start"), "phrase", "length").where("start >= 0")
        else:
            some = index.join(broadcast_if_small(own.select("term").distinct(), MOST), "term", "left_semi").select("row", F.col("pos"), "term")
            asked = found.where(F.col("length") >= rank).join(own.drop("length"), "phrase").withColumn("pos", F.col("start") + F.col("shift"))
            found = asked.join(some, ["row", "pos", "term"], "left_semi").select("row", "start", "phrase", "length")
        found = saved(found)
        short = found.where(F.col("length") == rank)
        done = short if done is None else done.unionByName(short)
    found = found.where(F.col("length") > LISTS)
    inside = index.join(broadcast_if_small(found.select("row").distinct(), MOST), "row", "left_semi").select("row", "pos", "term")
    asked = found.join(broadcast_if_small(probes.where(F.col("rank") > LISTS).select("phrase", "shift", "term"), MOST), "phrase")
    met = asked.withColumn("pos", F.col("start") + F.col("shift")).join(inside, ["row", "pos", "term"], "left_semi")
    whole = met.groupBy("row", "start", "phrase", "length").agg(F.count("*").alias("n")).where(F.col("n") == F.col("length") - LISTS)
    return saved(done.unionByName(whole.select("row", "start", "phrase", "length")))


def proximity(index: DataFrame, items: DataFrame, n: DataFrame, rarest: int = RAREST, share: float = SHARE) -> DataFrame:
    """(row, item_id) where ``share`` of the ``rarest`` rarest distinct terms of an item are close together.

    A stretch is twice as long as the item and begins at any posting. A document with all but a few of the terms has one of
    the rarest of them at least, so those lists name the documents first; the others are read for these only, shifted by
    where they stand, and each posting counts the terms that follow within the stretch.
    """
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    terms = own.select("item_id", F.size("w").alias("width"), F.explode("w").alias("term")).groupBy("item_id", "term").agg(F.max("width").alias("width"))
    order = Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "term")
    terms = terms.join(broadcast_if_small(n, MOST), "term", "left").withColumns({"rank": F.row_number().over(order), "kinds": F.least(F.lit(rarest), F.count("*").over(Window.partitionBy("item_id")))})
    terms = terms.where(F.col("rank") <= rarest).withColumn("need", F.ceil(F.lit(share) * F.col("kinds")).cast("int"))
    some = saved(terms.select("item_id", "term", F.max("width").over(Window.partitionBy("item_id")).alias("width"), "rank", "kinds", "need"))
    lead = some.where(F.col("rank") <= F.col("kinds") - F.col("need") + 1).select("item_id", "term")
    may = saved(index.join(broadcast_if_small(lead, MOST), "term").select("row", "item_id").distinct())
    inside = index.join(broadcast_if_small(may.select("row").distinct(), MOST), "row", "left_semi").select("row", "pos", "term")
    near = inside.join(broadcast_if_small(some.select("item_id", "term", "width", "need"), MOST), "term").join(broadcast_if_small(may, MOST), ["row", "item_id"], "left_semi")
    enough = near.groupBy("row", "item_id").agg(F.count_distinct("term").alias("found"), F.first("need").alias("need")).where("found >= need").select("row", "item_id")
    near = near.join(saved(enough), ["row", "item_id"], "left_semi").withColumn("at", F.col("pos") / F.col("width"))
    ahead = F.expr("size(collect_set(term) over (partition by row, item_id order by at range between current row and 1.9999999D following))")
    return near.withColumn("found", ahead).where("found >= need").select("row", "item_id").distinct()


def judged(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20, near: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted, comma-joined), contaminated, n_near.

    Without ``near`` no proximity matches are looked for, and n_near is 0.
    """
    own = saved(windows(items, size))
    phrases = own.select("phrase", "length").distinct()
    index = postings(docs, own.select(F.explode(F.split("phrase", " ")).alias("term")).distinct())
    n = frequencies(index)
    found = occurrences(index, phrases, n)
    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    hit = spans.withColumn("before", before).groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))))).alias("n_hit"))
    of = found.select("row", "phrase").join(broadcast_if_small(own.select("item_id", "phrase"), MOST), "phrase").select("row", "item_id").distinct()
    of = of.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items"))
    told = hit.join(of, "row")
    if near:
        told = told.join(proximity(index, items, n).groupBy("row").agg(F.count("*").alias("n_near")), "row", "full")
    told = saved(told if near else told.withColumn("n_near", F.lit(0).cast("long")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = index.where(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words")).join(broadcast_if_small(told, MOST), "row", "left")
    out = out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items", F.lit("")).alias("items"), zero("n_near"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the contaminated rows, whatever their ids.

    Contamination is judged by the phrases alone, so proximity, which has no part in it, is not looked for here.
    """
    key = "_text"  # equal texts are judged alike, so 128 bits of the text stand for the row and nothing is copied
    while key in docs.columns:
        key += "_"
    rows = docs.withColumn(key, F.struct(F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b")))
    bad = judged(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), near=False).where("contaminated")
    return without(rows, saved(bad.select(F.col("doc_id").alias(key)).distinct()), key)


def query(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated", "n_near")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p, least(13, len(w)) AS l
        FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM win),
runs AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS p FROM d, lens, unnest(range(1, len(w) - l + 2)) AS t(i)),
occ AS (SELECT * FROM runs WHERE p IN (SELECT p FROM win)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM occ, unnest(range(i, i + l)) AS u(pos) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ JOIN win USING (p)) GROUP BY doc_id),
bt AS (SELECT item_id, term, max(width) AS width FROM (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, len(w) AS width, unnest(w) AS term FROM b WHERE len(w) > 0) GROUP BY 1, 2),
ps AS (SELECT doc_id, i - 1 AS pos, w[i] AS term FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
tn AS (SELECT term, count(*) AS n FROM ps WHERE term IN (SELECT term FROM bt) GROUP BY 1),
rk AS (SELECT item_id, term, width, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), term) AS rank, ceil({SHARE} * least({RAREST}, count(*) OVER (PARTITION BY item_id))) AS need FROM bt LEFT JOIN tn USING (term)),
ce AS (SELECT doc_id, item_id, need, max(width) OVER (PARTITION BY item_id) AS width, term, pos FROM ps JOIN (SELECT item_id, term, need, rank, max(width) OVER (PARTITION BY item_id) AS width FROM rk WHERE rank <= {RAREST}) USING (term)),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT a.doc_id, a.item_id, a.pos FROM ce a JOIN ce b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.pos >= a.pos AND b.pos < a.pos + 2 * a.width GROUP BY a.doc_id, a.item_id, a.pos HAVING count(DISTINCT b.term) >= any_value(a.need)) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
