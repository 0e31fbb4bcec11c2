"""Personal data: spans by pattern, and terms whose co-occurrence in the corpus gives a person away.

Four kinds of span are found by pattern and check (:data:`KINDS`), each leftmost and without overlaps within its kind.
Their values are the protected entities. The words around a span are its context. For each term and entity the corpus
gives p(e|t), the share of the documents with the term in which it stands near the entity, and the disclosure
log2(p(e|t) / p(e)) in bits, p(e) being the share of documents with the entity. A document counts once, however often the
term stands near the entity in it. A term discloses an entity if it stands near it in ``support`` different contexts
(copies of a text are one context) and in as many documents, p(e|t) is at least ``certain`` and the disclosure at least
``bits``. Such terms become spans of the kind ``term`` in all documents; when a text is sanitised,
pattern spans are generalised to their kind and disclosing terms are removed, [TERM] staying in their place.

Only DataFrame expressions. The patterns match what the plain ones do, but never backtrack over a run of characters,
so that very long runs take linear time. Cases: a null text counts as empty; offsets count code points; repeated rows
get the same spans; a null doc_id is kept; a corpus without entities or without repeated contexts has no terms; an
empty table gives an empty result; columns beside doc_id and text are kept by ``sanitised`` and not read by ``spans``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.common import ascii_lower, broadcast_if_small, saved, table

#: kind: (pattern, cheap test that a text may have it, check of a match m). Order matters: spans at one start sort by it.
KINDS = {
    "email": (
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains({t}, '@')",
        "true",
    ),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "{t} rlike '[0-9][.][0-9]'",
        "forall(split({m}, '[.]'), x -> length(ltrim('0', x)) <= 3 and int(concat('0', left(ltrim('0', x), 3))) <= 255)",
    ),
    "card": (
        r"[0-9]++(?:[\x20-][0-9]++)*+",
        "{t} rlike '[0-9][ -]?[0-9]'",
        "length(translate({m}, ' -', '')) between 12 and 19 and luhn_check(translate({m}, ' -', ''))",
    ),
    "phone": (
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "contains({t}, '+')",
        "length(translate({m}, '+ ().-', '')) between 9 and 15",
    ),
}
ORDER = [*KINDS, "term"]
NEAR = 120  # characters on either side of a span that its context words come from
AROUND = 5  # context words on either side
LETTERS = r"[^A-Za-z\x{80}-\x{10FFFF}]"
MOST = 1_000_000


def _key():
    """One value of 128 bits for equal (doc_id, text): rows that agree in both have the same spans."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return F.struct(F.xxhash64(F.lit(1), *own).alias("a"), F.xxhash64(F.lit(2), *own).alias("b"))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), _key().alias("key"))


def found(rows: DataFrame, near: int = NEAR) -> DataFrame:
    """(key, doc_id, kind, start, end, value, before, after) of the pattern spans of rows (key, doc_id, text).

    before and after: up to ``near`` characters beside the span, and one more where there are more.
    """
    out = None
    for kind, (pattern, may, _) in KINDS.items():
        m, p = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
        cut = F.transform(
            F.arrays_zip(m.alias("m"), p.alias("p"), F.slice(p, 2, 1 << 30).alias("q")),
            lambda x: F.struct(x["m"].alias("m"), F.length(x["p"]).alias("skip"), F.substring(x["p"], -near - 1, near + 1).alias("before"), F.substring(x["q"], 1, near + 1).alias("after")),
        )
        part = rows.where(may.format(t="text")).select("key", "doc_id", F.lit(kind).alias("kind"), F.posexplode(cut).alias("i", "x")).select("key", "doc_id", "kind", "i", "x.*")
        out = part if out is None else out.unionByName(part)
    rows = saved(out.where("m is not null").distinct())
    upto = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("skip") + F.length("m")).over(upto)).withColumn("start", F.col("end") - F.length("m"))
    check = "case " + " ".join(f"when kind = '{k}' then {test.format(m='m')}" for k, (_, _, test) in KINDS.items()) + " end"
    return rows.where(F.expr(check)).select("key", "doc_id", "kind", "start", "end", F.col("m").alias("value"), "before", "after")


def _words(text):
    """Words, lower-cased; runs of letters, non-ASCII characters counting as such."""
    return F.filter(F.split(ascii_lower(text), LETTERS + "+"), lambda w: F.length(w) >= 1)


def _whole(piece: str, outer: str, near: int = NEAR):
    """piece of a text beside a span; where it is longer than ``near`` it was cut, and the outer word goes."""
    return F.when(F.length(piece) > near, F.regexp_replace(piece, outer, "")).otherwise(F.col(piece))


def disclosing(base: DataFrame, rows: DataFrame, support: int = 2, certain: float = 0.5, bits: float = 4.0, near: int = NEAR, around: int = AROUND) -> DataFrame:
    """(term, bits): terms that give an entity of base away, their co-occurrence counted over all rows.

    A term is near an entity if it is one of ``around`` words on either side, within ``near`` characters.
    """
    left = F.slice(F.reverse(_words(_whole("before", r"^[A-Za-z\x{80}-\x{10FFFF}]+", near))), 1, around)
    right = F.slice(_words(_whole("after", r"[A-Za-z\x{80}-\x{10FFFF}]+$", near)), 1, around)
    beside_it = base.select("key", F.xxhash64("kind", F.lower("value")).alias("entity"), left.alias("l"), right.alias("r"))
    beside_it = beside_it.select("key", "entity", F.xxhash64("l", "r").alias("context"), F.explode(F.array_distinct(F.concat("l", "r"))).alias("term"))
    pairs = beside_it.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("key").alias("both")).where((F.col("contexts") >= support) & (F.col("both") >= support))
    beside = beside_it.groupBy("term").agg(F.count_distinct("key").alias("beside"))  # near any entity: no more than all its documents
    pairs = saved(pairs.join(beside, "term").where(F.col("both") >= certain * F.col("beside")).drop("beside"))
    terms = saved(pairs.select("term").distinct())
    if terms.isEmpty():
        return terms.select("term", F.lit(0.0).alias("bits"))
    used = rows.select("key", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(broadcast_if_small(terms, MOST), "term")
    n_term = used.groupBy("term").agg(F.count("*").alias("docs"))
    n_entity = base.groupBy(F.xxhash64("kind", F.lower("value")).alias("entity")).agg(F.count_distinct("key").alias("with"))
    n = rows.count()
    told = pairs.join(n_term, "term").join(n_entity, "entity").withColumn("p", F.col("both") / F.col("docs"))
    told = told.withColumn("bits", F.log2(F.col("p") * F.lit(float(n)) / F.col("with"))).where((F.col("p") >= certain) & (F.col("bits") >= bits))
    return saved(told.groupBy("term").agg(F.max("bits").alias("bits")))


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, doc_id, kind, start, end) of the terms in rows."""
    slots = F.split(F.regexp_replace(ascii_lower(F.col("text")), LETTERS, " "), " ")
    cut = rows.select("key", "doc_id", slots.alias("w"))
    hit = cut.select("key", "doc_id", "w", F.posexplode("w").alias("i", "term")).join(broadcast_if_small(terms.select("term"), MOST), "term")
    start = F.when(F.col("i") == 0, 0).otherwise(F.length(F.array_join(F.slice("w", F.lit(1), F.col("i")), " ")) + 1)
    hit = hit.select("key", "doc_id", "term", start.cast("long").alias("start"))
    return hit.select("key", "doc_id", F.lit("term").alias("kind"), "start", (F.col("start") + F.length("term")).alias("end")).distinct()


def spans(docs: DataFrame, near: int = NEAR, around: int = AROUND, **thresholds) -> DataFrame:
    """(doc_id, kind, start, end) with key: pattern spans and those of disclosing terms."""
    rows = _text(docs)
    base = saved(found(rows, near))
    terms = disclosing(base, rows, near=near, around=around, **thresholds)
    own = base.select("key", "doc_id", "kind", "start", "end")
    return own if terms.isEmpty() else own.unionByName(term_spans(rows, terms))


def _joined(kinds: list[str]):
    some = F.array(*(F.lit(k) for k in kinds))
    own = F.transform(F.filter("all", lambda x: F.array_contains(some, x["kind"])), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(own, ",")


def query(spark, sf_dir: str) -> DataFrame:
    return result(table(spark, sf_dir, "documents"))


def result(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the number of spans of each pattern, a digest of them, and all spans."""
    docs = docs.select("doc_id", "text")
    place = F.array_position(F.array(*(F.lit(k) for k in ORDER)), F.col("kind"))
    own = spans(docs).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("all"))
    counts = [F.expr(f"cast(size(filter(`all`, x -> x.kind = '{k}')) as bigint) as n_{k}") for k in KINDS]
    own = own.select("key", *counts, _joined(list(KINDS)).alias("base"), _joined(ORDER).alias("spans"))
    out = _text(docs).select("key", "doc_id").join(own, "key", "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def free(name: str, taken: list[str]) -> str:
    """name, or a longer one that no column has."""
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def sanitised(docs: DataFrame, near: int = NEAR, around: int = AROUND, **thresholds) -> DataFrame:
    """docs with personal data generalised and disclosing terms removed from text; all other columns stay as they are."""
    rows = _text(docs)
    terms = disclosing(saved(found(rows, near)), rows, near=near, around=around, **thresholds)
    own = [F.col(f"`{c}`") for c in docs.columns]
    key, cut, some = (free(name, docs.columns) for name in ("_key", "_cut", "_terms"))
    out = docs.withColumn(key, _key())
    for kind, (pattern, may, check) in KINDS.items():
        parts = F.struct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("p"))
        told = f"array_join(zip_with({cut}.p, transform({cut}.m, m -> case when {check.format(m='m')} then '[{kind.upper()}]' else m end), (p, m) -> concat(p, coalesce(m, ''))), '')"
        out = out.withColumn(cut, F.when(F.expr(may.format(t="text")), parts))
        out = out.withColumn("text", F.expr(f"case when size({cut}.m) > 0 then {told} else text end")).drop(cut)
    if not terms.isEmpty():
        hit = rows.select("key", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(broadcast_if_small(terms.select("term"), MOST), "term")
        of = hit.distinct().groupBy(F.col("key").alias(key)).agg(F.array_join(F.sort_array(F.collect_list("term")), "|").alias(some))
        letter = r"A-Za-z\x{80}-\x{10FFFF}"
        any_ = F.concat(F.lit(f"(?i)(?<![{letter}])("), F.col(some), F.lit(f")(?![{letter}])"))
        out = out.join(broadcast_if_small(saved(of), MOST), key, "left")
        out = out.withColumn("text", F.when(F.col(some).isNotNull(), F.regexp_replace("text", any_, F.lit("[TERM]"))).otherwise(F.col("text")))
    return out.select(*own)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with sanitised texts; n_chars counts anew."""
    return sanitised(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))
