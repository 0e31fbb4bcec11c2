"""Near-duplicates by SimHash: exact comparison of fingerprints in tiles with exclusive-or and bit counts.

A fingerprint has 64 bits; two documents are linked if theirs differ in ``radius`` bits or fewer. Equal fingerprints
are one node. Cut into ``parts`` > radius pieces of bits, two linked fingerprints agree in ``parts - radius`` pieces at
least, so every link shows up in a bucket of nodes that agree in some choice of that many pieces: no pair is lost, and
no fingerprint meets all others. A bucket of up to ``tile`` nodes is one tile. A larger one is cut into tiles of equal
population count; pairs of its tiles whose population counts differ by more than the radius are skipped, all others are
tasks of their own, so no task grows with a bucket. Within a task links are joined into trees, so a group of n copies
leaves n - 1 rows, not all its pairs.

Cases: null and empty texts have fingerprint 0 and are linked like any other; texts of fewer words than a shingle are
one shingle; rows without an id get a fingerprint but no component; repeated rows get the same values; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.functions.shipping import ship
from gridtide.llm.common import batches_of, keyed, saved, table, without
from gridtide.llm.components import connected

BITS = 64
ROWS = 1000  # texts that a task holds at a time


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of the lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=False)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit is set if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[i : i + 8192]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""
    ship(docs.sparkSession)

    def task(batches):
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            values = np.array([fingerprint(shingle_hashes(t.as_py(), size)) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, "doc_id long, fp long")


def buckets(nodes: DataFrame, radius: int, parts: int) -> DataFrame:
    """A row (bucket, fp, node, ones) for each choice of parts - radius pieces."""
    cuts = [BITS * k // parts for k in range(parts + 1)]
    piece = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(cuts)]
    keys = [F.xxhash64(F.lit(k), *(piece[i] for i in some)) for k, some in enumerate(itertools.combinations(range(parts), parts - radius))]
    return nodes.select("fp", "node", F.bit_count("fp").alias("ones"), F.explode(F.array(*keys)).alias("bucket"))


def tiles(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """rows with the task (a, b: tiles of the bucket) and side (-1: both tiles are the same) of each comparison."""
    counts = rows.groupBy("bucket", "ones").agg(F.count("*").alias("n"))
    large = counts.groupBy("bucket").agg(F.sum("n").alias("all"), F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).alias("k"))).alias("cut")).where(F.col("all") > tile)
    large = saved(large.drop("all"))
    whole = rows.join(large, "bucket", "left_anti").select("bucket", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(-1).alias("side"), "fp", "node", "ones")
    own = F.expr("ones * 100000L + pmod(xxhash64(fp), filter(cut, x -> x.ones = ones)[0].k)")
    others = F.expr(f"flatten(transform(filter(cut, x -> abs(x.ones - ones) <= {radius}), x -> transform(sequence(0L, x.k - 1), s -> x.ones * 100000L + s)))")
    cut = rows.join(large, "bucket").withColumn("own", own).withColumn("other", F.explode(others))
    cut = cut.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.expr("case when own = other then -1 when own < other then 0 else 1 end").alias("side"), "fp", "node", "ones")
    return whole.withColumns({"a": F.col("a").cast("long"), "b": F.col("b").cast("long")}).unionByName(cut)


def joined_up(node: np.ndarray, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (positions) after the links i-j: the smallest position that each one reaches."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label != (up := label[label])).any():
            label = up
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
    return label


def compared(key: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray, ones: np.ndarray, radius: int, block: int = 1 << 20):
    """Tree links (a, b) of all linked pairs within equal keys; rows in order of key, side, ones."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    label = np.arange(len(key))
    few = np.repeat((size <= 64), size) & (side < 0)  # small tiles: all of them together, by distance in the order
    at, end = np.flatnonzero(few), np.repeat(first + size, size)
    for d in range(1, 64):
        at = at[at + d < end[at]]
        if not len(at):
            break
        near = ones[at + d] - ones[at] <= radius
        at = at[near]  # in order of ones, what is further off differs more
        hit = np.bitwise_count(fp[at] ^ fp[at + d]) <= radius
        label = joined_up(node, at[hit], at[hit] + d, label)
    for f, n in zip(first, size, strict=True):
        if few[f] or n < 2:
            continue
        two = side[f] >= 0
        left = np.arange(f, f + (int((side[f : f + n] == 0).sum()) if two else n))
        right = np.arange(left[-1] + 1 if two and len(left) else f, f + n)
        if not len(left) or not len(right):
            continue
        step = max(1, block // len(right))
        for a in range(0, len(left), step):
            rows = left[a : a + step]
            x, y = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[right][None, :]) <= radius)
            x, y = rows[x], right[y]
            label = joined_up(node, x[x != y], y[x != y], label)
    off = np.flatnonzero(label != np.arange(len(label)))
    return node[off], node[label[off]]


def links(nodes: DataFrame, radius: int = 4, parts: int = 6, tile: int = 4096) -> DataFrame:
    """(a, b): links that join all nodes (fp, node) within the radius of each other."""
    rows = tiles(saved(buckets(nodes, radius, parts)), radius, tile)

    def task(batches):
        def cut(frame, last):
            key, rest = frame["key"], len(frame["key"])
            if not last and rest:
                rest = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            return {k: v[:rest] for k, v in frame.items()}, {k: v[rest:] for k, v in frame.items()}

        def found(part):
            if len(part["key"]):
                a, b = compared(part["key"], part["side"], part["fp"].view(np.uint64), part["node"], part["ones"], radius)
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        held = None
        for batch in batches:
            now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(("key", "side", "fp", "node", "ones"))}
            held = now if held is None else {k: np.concatenate((held[k], now[k])) for k in now}
            part, held = cut(held, False)
            yield from found(part)
        if held is not None:
            yield from found(held)

    dealt = rows.select(F.xxhash64("bucket", "a", "b").alias("key"), "side", "fp", "node", F.col("ones").cast("int").alias("ones"))
    return dealt.repartition("key").sortWithinPartitions("key", "side", "ones").mapInArrow(task, "a long, b long")


def grouped(prints: DataFrame, radius: int = 4, parts: int = 6, tile: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) of fingerprints (doc_id, fp)."""
    nodes = saved(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    root = connected(links(nodes, radius, parts, tile))
    named = saved(nodes.join(root, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")))
    named = prints.where("doc_id is not null").join(named, "fp").select("doc_id", "fp", "component_id")
    return named.unionByName(prints.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id, rows without one coming last.

    Rows that share an id, or have none, are compared and judged one by one.
    """
    rows, key = keyed(docs)
    with batches_of(spark, ROWS):
        prints = saved(fingerprints(rows, doc_id=key))  # the key stands for the id here
    groups = saved(grouped(prints).select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, "doc_id"), key))
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))).alias("m"))
    kept = first.select(F.col("m.key").alias(key))
    return without(rows, groups.select(key).join(kept, key, "left_anti"), key)


def query(spark, sf_dir: str) -> DataFrame:
    with batches_of(spark, ROWS):
        prints = saved(fingerprints(table(spark, sf_dir, "documents")))
    groups = grouped(prints)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
