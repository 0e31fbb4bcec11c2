"""Spelling variants: words one inserted, deleted or replaced letter apart, found by Aho-Corasick over halves of words.

Every word is cut into two segments. Of two words that are one edit apart, one has a segment of the other whole: its
first one at the start, or its last one at the end. Shards of automata hold the segments of all words. A word is scanned
by the shards that may hold a prefix or a suffix of it of a fitting length, once each; a hit counts if the offset is
that of the segment and the lengths differ by one letter at most, and the rest of both words is then compared exactly.
A segment of very many words is split over several shards, each of which scans the words that fit it, so no automaton
grows with a segment. What a task gives back is one row for a word: how many near words it saw and the best of them.

Words are numbered in order of falling counts, then of code points: the best near word has the least number. A word's
form is its best near word, if that is ``ratio`` times as frequent at least; roots follow the forms by doubling.

Cases: a null text has no words; a null id counts as an empty one in the digest that decides on deletions; ties go to
the word that is first in code-point order; a text or word of any length is taken whole; repeated rows count each time;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.functions.shipping import ship
from gridtide.llm.common import ascii_lower, broadcast_if_small, saved, table

LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
SHARD = 40_000  # segments of an automaton, about
SPLIT = 8192  # words that share a segment within a shard
LETTER = r"[A-Za-z\x{C0}-\x{FF}]"


def counted(docs: DataFrame, damage: int | None = 97, least: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the lower-cased runs of letters. One run in ``damage``, by crc32 of id and run, has lost a letter."""
    runs = F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", ascii_lower(F.col("run")).alias("run"))
    if damage:
        rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        rows = rows.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("run"))
    words = rows.where(F.length("run") >= least).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return words.where(F.col("n") >= count)


def numbered(words: DataFrame) -> DataFrame:
    """words (word, n) with id: the more frequent, then the smaller word has the smaller one."""
    order = [F.desc("n"), F.asc("word")]
    return saved(words.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))


def packed(words: list[str]) -> np.ndarray:
    """Words of 8 letters at most as numbers, the first letter lowest; letters are those of Latin-1."""
    return np.frombuffer(b"".join(w.encode("latin-1").ljust(8, b"\0") for w in words), "<u8")


def one_edit(p: np.ndarray, t: np.ndarray, longer: int) -> np.ndarray:
    """Whether packed p and t (of a shape that numpy can pair) are one edit apart; t has ``longer`` letters more: -1, 0, 1."""
    if longer < 0:
        p, t = t, p
    differ = p ^ t
    low = np.bitwise_count((differ & -differ) - np.uint64(1)).astype(np.uint64) & np.uint64(56)  # bits before the first letter that differs
    if longer:
        low = np.minimum(low, np.uint64(56))
        return (t >> low >> np.uint64(8)) == (p >> low)
    return (differ != 0) & (differ >> low >> np.uint64(8) == 0)


def edits_are_one(a: str, b: str) -> bool:
    """Whether a and b of any length are one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class Shard:
    """Segments of some words in an automaton."""

    def __init__(self):
        self.held: dict[tuple[str, int], list] = {}  # (segment, role): words by the length of the rest

    def add(self, segment: str, role: int, word: str, number: int) -> None:
        rest = word[len(segment) :] if role == 0 else word[: -len(segment)]
        self.held.setdefault((segment, role), {}).setdefault(len(rest), []).append((rest, number))

    def close(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for segment in {s for s, _ in self.held}:
            self.automaton.add_word(segment, segment)
        if self.held:
            self.automaton.make_automaton()
        for by in self.held.values():
            for size, some in by.items():
                rests, numbers = [r for r, _ in some], np.array([n for _, n in some], np.int64)
                by[size] = (rests, packed(rests) if size <= 8 else None, numbers)

    def scan(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: how many words of this shard are near, and the least number of these."""
        near, best = np.zeros(len(words), np.int64), np.full(len(words), np.iinfo(np.int64).max)
        fits: dict[tuple, list[int]] = {}
        if not self.held:
            return near, best
        for i, word in enumerate(words):
            for end, segment in self.automaton.iter(word):
                if end + 1 == len(segment) and (segment, 0) in self.held:
                    fits.setdefault((segment, 0, len(word) - len(segment)), []).append(i)
                if end + 1 == len(word) and (segment, 1) in self.held:
                    fits.setdefault((segment, 1, len(word) - len(segment)), []).append(i)
        for (segment, role, size), at in fits.items():
            rest = [words[i][len(segment) :] if role == 0 else words[i][: len(words[i]) - len(segment)] for i in at]
            for other in (size - 1, size, size + 1):
                if (held := self.held[segment, role].get(other)) is None:
                    continue
                self._compared(segment, role, size, rest, np.array(at), other, held, near, best)
        return near, best

    def _compared(self, segment, role, size, rest, at, other, held, near, best) -> None:
        rests, codes, numbers = held
        if codes is None or size > 8 or len(rests) * len(rest) <= 12:
            for i, r in zip(at, rest, strict=True):
                hit = [k for k, p in enumerate(rests) if edits_are_one(p, r) and not (role == 1 and (r + segment).startswith(p))]
                if hit:
                    near[i] += len(hit)
                    best[i] = min(best[i], numbers[hit].min())
            return
        own = packed(rest)
        step = max(1, (1 << 19) // len(rests))
        for k in range(0, len(own), step):
            t = own[k : k + step, None]
            hit = one_edit(codes[None, :], t, size - other)
            if role == 1:  # words that begin with the other's first segment as well were seen with that one
                if size >= other:
                    hit &= (t & np.uint64((1 << 8 * other) - 1)) != codes[None, :]
                else:
                    hit &= (t | np.uint64(ord(segment[0]) << 8 * size)) != codes[None, :]
            i, j = np.nonzero(hit)
            np.add.at(near, at[k + i], 1)
            np.minimum.at(best, at[k + i], numbers[j])


def near(words: DataFrame, shard: int = SHARD, split: int = SPLIT) -> DataFrame:
    """(id, n_near, best: the least id of a near word) of words (id, word, n) that have near words."""
    spark = ship(words.sparkSession)
    segments = words.select("id", "word", F.explode(F.expr("array(struct(0 as role, left(word, length(word) div 2) as segment), struct(1 as role, substring(word, length(word) div 2 + 1) as segment))")).alias("x")).select("id", "word", "x.*")
    sizes = segments.groupBy("role", "segment").agg(F.count("*").alias("many"))
    large = saved(sizes.where(F.col("many") > split).select("role", "segment", F.ceil(F.col("many") / split).cast("int").alias("parts")))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * words.count() // shard + 1)
    large = broadcast_if_small(large, 1_000_000)
    place = lambda part: F.pmod(F.xxhash64("role", "segment", part), F.lit(shards)).alias("shard")
    part = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1)))
    patterns = segments.join(large, ["role", "segment"], "left").select(place(part), F.lit(0).alias("kind"), "role", "segment", "word", "id")
    half = F.expr(f"array_distinct(transform(array(length(word) - 1, length(word), length(word) + 1), x -> greatest(x, {LEAST_LETTERS}) div 2))")
    other = F.expr(f"array_distinct(transform(array(length(word) - 1, length(word), length(word) + 1), x -> least(length(word), greatest(x, {LEAST_LETTERS}) - greatest(x, {LEAST_LETTERS}) div 2)))")
    keys = F.concat(F.transform(half, lambda k: F.struct(F.lit(0).alias("role"), F.left(F.col("word"), k).alias("segment"))), F.transform(other, lambda k: F.struct(F.lit(1).alias("role"), F.right(F.col("word"), k).alias("segment"))))
    scans = words.select("id", "word", F.explode(keys).alias("x")).select("id", "word", "x.*").join(large, ["role", "segment"], "left")
    scans = scans.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    scans = scans.select(place(F.col("part").cast("long")), F.lit(1).alias("kind"), F.lit(0).alias("role"), F.lit("").alias("segment"), "word", "id").distinct()

    def task(batches):
        now, held, closed = None, None, False
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            words, ids = [], []

            def scanned():
                many, best = held.scan(words)
                some = np.flatnonzero(many)
                return pa.record_batch([pa.array(np.array(ids, np.int64)[some]), pa.array(many[some]), pa.array(best[some])], names=["id", "n_near", "best"])

            for where, kind, role, segment, word, number in zip(*columns, strict=True):
                if where != now:
                    if words:
                        yield scanned()
                        words, ids = [], []
                    now, held, closed = where, Shard(), False
                if kind == 0:
                    held.add(segment, role, word, number)
                    continue
                if not closed:
                    held.close()
                    closed = True
                words.append(word)
                ids.append(number)
            if words:
                yield scanned()

    dealt = patterns.withColumn("id", F.col("id")).unionByName(scans).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(task, "id long, n_near long, best long")
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(id, root) of forms (id, form): the end of each chain, by doubling."""
    links = saved(forms.select("id", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        links = saved(links.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.select("id", "root")
        links = links.select("id", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n)."""
    words = numbered(words)
    seen = saved(near(words))
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    rows = words.join(seen, "id", "left").join(best, "best", "left").withColumn("fits", F.coalesce(F.col("form_n") >= F.lit(ratio) * F.col("n"), F.lit(False)))
    rows = saved(rows)
    root = rooted(rows.where("fits").select("id", F.col("best").alias("form")))
    root = root.join(words.select(F.col("id").alias("root"), F.col("word").alias("end")), "root").select("id", "end")
    rows = rows.join(root, "id", "left")
    return rows.select("word", F.when(F.col("fits"), F.col("form")).alias("form"), F.coalesce("end", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("fits"), F.col("form_n")).alias("form_n"))


def query(spark, sf_dir: str) -> DataFrame:
    return variants(counted(table(spark, sf_dir, "documents").select("doc_id", "text")))


_BYTES = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, 128 + unicode(c) % 64] END))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{LETTER}+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
grouped AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, n, {_CRC} AS h FROM grouped),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS MATERIALIZED (SELECT DISTINCT word, i, left(word, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.rest
          UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest),
best AS (SELECT p.word, count(*) AS n_near, min({{'a': -w.n, 'b': encode(p.other)}}) AS b, arg_min(p.other, {{'a': -w.n, 'b': encode(p.other)}}) AS other, max(w.n) AS other_n FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
