"""Language identification with interpolated Kneser-Ney character models.

Training counts the character n-grams of every labelled row: each task sums its own counts, Spark adds them up. All
n-grams of all languages are kept, and continuation counts, discounts and back-off weights are sums over these tables.
For scoring the rows are cut into blocks; the distinct n-grams of all blocks get their interpolated log-probabilities by
joins, and each block of texts meets those of its own n-grams as an array of hashes in ascending order; a radix index
over the leading bits of the hash replaces the binary search. Characters are lower-cased letters; every run of other
characters counts as one boundary symbol.

Cases: a null text and a text without a letter get ``und`` and score 0. Null labels and labels of rows outside the
training split are not learned from. With no labelled row at all every text gets ``und``. Repeated rows and ids are
scored one by one; a null doc_id counts as held out; further columns of the input are kept as they are (``columns``). Texts of any length are read whole,
in pieces of about 250 000 characters that meet at a document's end only.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.functions.shipping import ship
from gridtide.llm.common import batches_of, keyed, remainder, saved, table, without

ORDER = 4
PIECE = 250_000
ROWS = 1000  # texts that a task holds at a time
APART = 1  # remainder of the training rows that only set the limits
BLOCK = 8_000_000  # characters of the texts that are scored together
SEP = "" * (ORDER - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def letters() -> np.ndarray:
    """Code point -> lower-case letter as uint16; 0 for all that is no letter, 65535 for letters above the BMP."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ord(ch.lower()[0])
            out[c] = low if low < 0x10000 else 0xFFFF
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts, ORDER - 1 zeros before each; where each text begins and ends among them."""
    joined = SEP + SEP.join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    y = letters()[points]
    keep = (y != 0) | (points == 0xE000)
    keep[1:] |= y[:-1] != 0
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lens + len(SEP)) - lens
    kept = np.concatenate(([0], np.cumsum(keep)))
    return y[keep], kept[begin], kept[begin + lens]


def packed(y: np.ndarray) -> np.ndarray:
    """n-grams of ORDER symbols, 16 bits each, one for each last symbol; the first ORDER - 1 have none."""
    z = y.astype(np.uint64)
    out = z[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        out |= z[ORDER - 1 - k : len(z) - k] << np.uint64(16 * k)
    return out


def pieces(texts: list[str]):
    """Ranges of about PIECE characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 3
        if size >= PIECE:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def counted(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable") if weights is not None else None
    grams = np.sort(grams) if order is None else grams[order]
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    if weights is None:
        return grams[first], np.diff(np.append(first, len(grams)))
    return grams[first], np.add.reduceat(weights[order], first)


def count_task(batches):
    """Sums of a task's n-grams by language: (lang, gram, n)."""
    seen: dict[str, list] = {}

    def merged(lang):
        g, n = (np.concatenate(x) for x in zip(*seen[lang], strict=True))
        seen[lang] = [counted(g, n)]

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_lang: dict[str, list[str]] = {}
        for t, lang in zip(texts, langs, strict=True):
            by_lang.setdefault(lang, []).append(t)
        for lang, own in by_lang.items():
            for a, b in pieces(own):
                y, start, end = symbols(own[a:b])
                seen.setdefault(lang, []).append(counted(packed(y)[inside(y, start, end)]))
            if lang in seen and sum(len(g) for g, _ in seen[lang][1:]) > 1_000_000:
                merged(lang)
    for lang in seen:
        merged(lang)
        g, n = seen[lang][0]
        for i in range(0, len(g), 100_000):
            part = g[i : i + 100_000]
            yield pa.record_batch([pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(n[i : i + 100_000].astype(np.int64))], names=["lang", "gram", "n"])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of labelled (text, lang)."""
    return labelled.select("text", "lang").mapInArrow(count_task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Lookup:
    """Ascending hashes, their values, and the range of each value of the leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = keys * MIX
        order = np.argsort(h)
        self.hash, self.values = h[order], np.ascontiguousarray(values[order], dtype=np.float32)
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 1))
        self.start = np.searchsorted(self.hash >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is missing."""
        h = keys * MIX
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(keys), -1, np.int32)
        if not len(self.hash):
            return out
        hit = (self.hash[np.minimum(at, len(self.hash) - 1)] == h) & (at < end)
        out[hit] = at[hit]
        left = np.flatnonzero(~hit & (at + 1 < end))
        at = at[left]
        while len(left):
            at = at + 1
            ok = self.hash[np.minimum(at, len(self.hash) - 1)] == h[left]
            out[left[ok]] = at[ok]
            go = ~ok & (at + 1 < end[left])
            left, at = left[go], at[go]
        return out


def mask(n: int) -> int:
    """The bits of the last n symbols of an n-gram."""
    return (1 << (16 * n)) - 1 if n < ORDER else -1


def numbered(texts: pa.Array, part: pa.Array, size: int) -> tuple[np.ndarray, int]:
    """The block of each text of a partition after ``size`` characters, and the characters then: runs of about BLOCK."""
    lens = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 3
    before = size + np.cumsum(lens) - lens
    return (part.to_numpy(zero_copy_only=False).astype(np.int64) << 32) + before // BLOCK, size + int(lens.sum())


def block_grams(batches):
    """Distinct (block, gram) of rows (text, partition)."""
    block, seen, size = None, [], 0

    def told():
        g = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        for i in range(0, len(g), 100_000):
            part = g[i : i + 100_000]
            yield pa.record_batch([pa.array(np.full(len(part), block)), pa.array(part.view(np.int64))], names=["block", "gram"])

    for batch in batches:
        blocks, size = numbered(batch.column(0), batch.column(1), size)
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for own in np.unique(blocks).tolist():  # ascending, as they come
            if own != block:
                yield from told()
                block, seen = own, []
            at = np.flatnonzero(blocks == own)
            some = texts[at[0] : at[-1] + 1]
            for a, b in pieces(some):
                y, start, end = symbols(some[a:b])
                seen.append(np.unique(packed(y)[inside(y, start, end)]))
    yield from told()
    pa.default_memory_pool().release_unused()


def inside(y: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each n-gram of y ends within a text."""
    out = np.zeros(len(y) + 1, np.int8)
    np.add.at(out, start, 1)
    np.add.at(out, end, -1)
    return np.cumsum(out[:-1])[ORDER - 1 :] > 0


def entropies(texts: list[str], priced: Lookup, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Nats a symbol by language, and the number of symbols that are letters; priced has all n-grams of the texts."""
    entropy, size = np.zeros((len(texts), n_langs)), np.zeros(len(texts), np.int64)
    for a, b in pieces(texts):
        y, start, end = symbols(texts[a:b])
        at, own = priced.find(packed(y)), inside(y, start, end)
        if (at[own] < 0).any():
            raise RuntimeError("the rows to score were not the same when they were read again")
        sums = np.zeros((len(y) + 1, n_langs))
        if own.any():
            np.cumsum(np.where(own[:, None], priced.values[at], 0), axis=0, out=sums[ORDER:], dtype=np.float64)
        alpha = np.concatenate(([0], np.cumsum(y != 0)))
        size[a:b] = alpha[end] - alpha[start]
        entropy[a:b] = -(sums[end] - sums[start]) / np.maximum(end - start, 1)[:, None]
    return entropy, size


class KneserNey:
    """Interpolated Kneser-Ney models of several languages, as tables of all n-grams.

    ``level[n]`` has (at, gram, n): the index of the language, the n-gram, and its count; in lower orders the counts
    are continuation counts, the number of distinct left neighbours. Only numbers by language and order are gathered.
    """

    def __init__(self, langs: list[str], rows: DataFrame):
        self.langs = langs
        if not langs:
            return
        index = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
        self.level = {ORDER: rows.select(index.cast("int").alias("at"), "gram", "n")}
        for n in range(ORDER - 1, 0, -1):
            suffix = F.col("gram").bitwiseAND(F.lit(mask(n)))
            self.level[n] = saved(self.level[n + 1].groupBy("at", suffix.alias("gram")).agg(F.count("*").alias("n")))
        self.total, self.discount = np.zeros(len(langs)), {n: np.zeros(len(langs)) for n in range(2, ORDER + 1)}
        for n, own in self.level.items():
            for r in own.groupBy("at").agg(F.sum("n").alias("total"), F.expr("count_if(n = 1)").alias("once"), F.expr("count_if(n = 2)").alias("twice")).collect():
                if n == 1:
                    self.total[r["at"]] = r["total"]
                else:
                    self.discount[n][r["at"]] = min(max(r["once"] / max(r["once"] + 2 * r["twice"], 1), 0.1), 0.95)
        self.size = self.level[1].select("gram").distinct().count() + 1

    def _by_lang(self, value):
        return F.array(*(F.sum(F.when(F.col("at") == i, value).otherwise(0)) for i in range(len(self.langs))))

    def priced(self, needed: DataFrame) -> DataFrame:
        """(gram, log_p) of distinct ORDER-grams: natural log-probabilities of the last symbol, one for each language."""
        numbers = lambda values: F.array(*(F.lit(float(v)) for v in values))
        # the unigrams: continuation counts with one added, for symbols never seen too
        own = needed.select(F.col("gram").bitwiseAND(F.lit(mask(1))).alias("gram")).distinct()
        own = own.join(self.level[1].groupBy("gram").agg(self._by_lang(F.col("n")).alias("c")), "gram", "left").withColumn("size", numbers(self.total + self.size))
        below = own.select(F.col("gram").alias("rest"), F.expr("transform(size, (s, i) -> (coalesce(c[i], 0) + 1) / s)").alias("below"))
        for n in range(2, ORDER + 1):
            before = F.shiftrightunsigned("gram", 16).alias("before")
            own = needed.select(F.col("gram").bitwiseAND(F.lit(mask(n))).alias("gram")).distinct()
            own = own.join(self.level[n].groupBy("gram").agg(self._by_lang(F.col("n")).alias("c")), "gram", "left")
            own = own.select("gram", before, F.col("gram").bitwiseAND(F.lit(mask(n - 1))).alias("rest"), "c")
            own = own.join(self.level[n].groupBy(before).agg(self._by_lang(F.col("n")).alias("total"), self._by_lang(F.lit(1)).alias("kinds")), "before", "left")
            own = own.join(below, "rest").withColumn("discount", numbers(self.discount[n]))
            p = "transform(discount, (d, i) -> greatest(coalesce(c[i], 0) - d, 0) / greatest(coalesce(total[i], 0), 1) + if(coalesce(total[i], 0) > 0, d * kinds[i] / total[i], 1) * below[i])"
            below = saved(own.select(F.col("gram").alias("rest"), F.expr(p).alias("below")))
        return below.select(F.col("rest").alias("gram"), F.expr("transform(below, p -> float(ln(p)))").alias("log_p"))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`entropies`, of a few texts in the driver."""
        spark = self.level[ORDER].sparkSession
        rows = spark.createDataFrame([(t, 0) for t in texts], "text string, block long")
        return entropies(texts, prices(self.priced(rows.coalesce(1).mapInArrow(block_grams, "block long, gram long").select("gram")).toArrow(), len(self.langs)), len(self.langs))


def prices(rows: pa.Table, n_langs: int) -> Lookup:
    """Rows (gram, log_p) by gram."""
    grams = rows.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    values = rows.column("log_p").combine_chunks()
    return Lookup(grams, np.asarray(values.flatten()).reshape(len(grams), n_langs))


def fit(labelled: DataFrame) -> KneserNey:
    """Models of all languages in labelled (text, lang), from all n-grams of all its rows."""
    ship(labelled.sparkSession)
    rows = saved(gram_counts(labelled.where("text is not null and lang is not null")))
    return KneserNey(sorted(r["lang"] for r in rows.select("lang").distinct().collect()), rows)


def blocked(docs: DataFrame) -> DataFrame:
    """docs, the last column a text, with ``_block``: runs of rows of one partition with about BLOCK characters."""

    def task(batches):
        size = 0
        for batch in batches:
            blocks, size = numbered(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(blocks)], names=batch.schema.names)

    rows = docs.withColumn("_block", F.spark_partition_id().cast("long"))
    return rows.mapInArrow(task, rows.schema)


def score(docs: DataFrame, model: KneserNey, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns, lang_pred, score, entropy and n_letters of each row.

    The rows are cut into blocks. The distinct n-grams of each block are joined with their log-probabilities, and each
    block of texts then meets those of its own n-grams. docs is read twice and has to give the same rows in the same
    partitions, as tables do; else the run fails.
    """
    schema = docs.select(*columns).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("entropy", "double"), ("n_letters", "long")):
        schema = schema.add(name, kind)
    if not model.langs:
        return docs.select(*columns, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(0).cast("long").alias("n_letters"))
    langs, names = model.langs, schema.names
    rows = blocked(docs.select(*columns, F.col(text).alias("_whole_text")))
    # the same rows are numbered here again, in one Python worker a task
    grams = saved(docs.select(text, F.spark_partition_id().cast("long")).mapInArrow(block_grams, "block long, gram long"))
    own = grams.join(model.priced(saved(grams.select("gram").distinct())), "gram").select(F.col("block").alias("_block"), "gram", "log_p")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = [t or "" for t in left.column("_whole_text").to_pylist()]
        entropy, size = entropies(texts, prices(right, len(langs)), len(langs))
        gaps = (entropy - entropy.min(1)[:, None]) * np.minimum(size, 200)[:, None]
        known = size > 0
        pred = np.where(known, np.array(langs, object)[entropy.argmin(1)], "und")
        pa.default_memory_pool().release_unused()  # workers are used again by the stages to come
        conf, ent = np.where(known, 1.0 / np.exp(-gaps).sum(1), 0.0), np.where(known, entropy.min(1), np.nan)
        return pa.Table.from_arrays([*left.columns[:-2], pa.array(pred, pa.string()), pa.array(conf), pa.array(ent, from_pandas=True), pa.array(size)], names=names)

    return rows.groupBy("_block").cogroup(own.groupBy("_block")).applyInArrow(task, schema)


def calibrated(scored: DataFrame, known, spread: float = 4.0, least: int = 20) -> DataFrame:
    """scored with ``rejected``: no letter, or an entropy that no text of its language comes near.

    The limit of each language is its median plus ``spread`` times the way from the median to the 99th percentile,
    over the rows for which the condition ``known`` holds: those labelled with the language that they were given and
    held out of the fit. The other rows that are judged have no part in it. A language with fewer than ``least`` such
    rows has no limit, and none of its rows is rejected; there is one row of limits for each language.
    """
    limits = scored.where((F.col("lang_pred") != "und") & known).groupBy("lang_pred").agg(F.expr("percentile_approx(entropy, array(0.5, 0.99), 1000)").alias("q"), F.count("*").alias("rows"))
    limits = limits.where(F.col("rows") >= least).select("lang_pred", (F.col("q")[0] + spread * (F.col("q")[1] - F.col("q")[0])).alias("most"))
    return scored.join(F.broadcast(limits), "lang_pred", "left").withColumn("rejected", (F.col("lang_pred") == "und") | F.coalesce(F.col("entropy") > F.col("most"), F.lit(False)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those in no language of the models, which learn from the labels of the same docs.

    One in five of the labelled rows is kept apart from the models and sets their limits. Rows are judged one by one,
    whatever their ids; all columns stay.
    """
    rows, key = keyed(docs)
    apart = F.coalesce(remainder(F.col("doc_id"), 5) == APART, F.lit(False))
    with batches_of(spark, ROWS):
        model = fit(rows.where(~apart))
        scored = saved(score(rows.select(key, "text", F.when(apart, F.col("lang")).alias("lang")), model, columns=(key, "lang")))
    return without(rows, calibrated(scored, F.col("lang") == F.col("lang_pred")).where("rejected"), key)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    split = F.coalesce(remainder(F.col("doc_id"), 5), F.lit(0).cast("long"))
    with batches_of(spark, ROWS):
        model = fit(docs.where((split != 0) & (split != APART)))
        scored = saved(score(docs.select("doc_id", "text", F.when(split == APART, F.col("lang")).alias("lang")), model, columns=("doc_id", "lang")))
    out = calibrated(scored, F.col("lang") == F.col("lang_pred"))
    return out.select("doc_id", (split == 0).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
