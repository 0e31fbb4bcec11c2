"""Near-duplicates by the Jaccard similarity of word n-grams: an exact join, with its groups as components.

A document's set has the hashes (64 bits) of its distinct shingles. Two sets link if their similarity is ``num / den``
or more; then their sizes are within that ratio and they differ in at most ``allowed`` shingles.

1. Equal texts are one node, so a group of copies is one row from here on.
2. Sizes are banded, and a band cuts the range of hashes into more parts than a linked pair may differ in. So two linked
   sets agree in some of the first parts of the smaller one's band, ``spare + 1`` of them at least, and meet in the
   bucket of such a part. Parts without a shingle make no bucket unless a set has more than ``spare`` of them: of two
   linked sets of which one has fewer, a part that is not empty agrees. No pair is lost, and passages that many
   documents share bring only those together whose whole part is shared.
3. Buckets with the same members are one. A bucket is a tile of sets in order of size; a large one is cut by classes of
   size, and only tiles whose sizes are within the ratio meet. Every set has a bitmap, the parity of its hashes by their
   low bits: the bits in which two bitmaps differ are no more than the shingles in which the sets do, so they bound the
   overlap from above. Pairs within the bound leave the task as a forest, not as all pairs.
4. The forest's pairs are held against the sorted arrays of hashes. Only where one fails may its trees be joined by
   other pairs: then all pairs between the parts that are left are compared, in tiles cut by size and bytes, first by
   bitmap, then by intersection.

Cases: nulls and texts without words have an empty set and link with nothing, not even with each other; a text of fewer
words than a shingle is one shingle; rows without an id link others but get no component of their own; repeated rows and
ids get the values of each row's own text; an empty table gives no rows; other columns of the input are not read. Equal
64-bit hashes count as equal shingles and texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.functions.shipping import ship
from gridtide.llm.common import ascii_lower, broadcast_if_small, saved, table
from gridtide.llm.components import connected
from gridtide.llm.simhash import joined_up

SIZE = 5
NUM, DEN = 80, 100
TILE = 2048  # sets of a tile
LOAD = 1 << 20  # hashes of a tile whose pairs are intersected
MOST_BITS = 1 << 16
PART = 1 << 18  # nodes of a bucket that leave a task as one row
MOST = 2_000_000
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every bit depends on all."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of the lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.array([], U)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))
    size = min(size, len(own))
    out = np.full(len(own) - size + 1, size, U)
    for k in range(size):
        out = (out ^ own[k : k + len(out)]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(32)
    return np.unique(mixed(out))


def allowed(a, b, num: int = NUM, den: int = DEN):
    """In how many members sets of sizes a and b may differ and link; negative where they can't."""
    return a + b - 2 * -((a + b) * num // -(num + den))


def edges(most: int) -> list[int]:
    """The first sizes of the bands, up to one beyond ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return [*out, max(out[-1] + 1, out[-1] * 3 // 2)]


def part_keys(hashes: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The buckets of a set, of its own band and of the one below if that has sizes within the ratio."""
    n = len(hashes)
    if not n:
        return np.array([], np.int64)
    first = edges(n)
    own = max(b for b, e in enumerate(first) if e <= n)
    content = mixed(hashes ^ U(0x5851F42D4C957F2D))
    out = []
    for band in (own, own - 1):
        if band < 0 or n * num > (first[band + 1] - 1) * den:  # no set of this band is large enough for this one
            continue
        spare = 0 if first[band] < 4 else 1 + first[band] // 32
        differ = lambda size: size * (den - num) // num  # noqa: E731  the most that a pair with this smaller size may differ in
        parts = differ(first[band + 1] - 1) + 1 + spare
        used = min(parts, differ(n) + 1 + spare)
        part = ((hashes >> U(32)) * U(parts)) >> U(32)
        upto = int(np.searchsorted(part, used))
        starts = np.flatnonzero(np.concatenate(([True], part[1:upto] != part[: upto - 1]))) if upto else np.array([], np.int64)
        sums = np.add.reduceat(content[:upto], starts) if upto else np.array([], U)
        held = part[starts]
        if used - len(held) > spare:
            empty = np.setdiff1d(np.arange(used, dtype=U), held)
            held, sums = np.concatenate((held, empty)), np.concatenate((sums, np.zeros(len(empty), U)))
        out.append(mixed(sums ^ mixed(held + U(((band + 1) << 32) + 1))))
    return np.concatenate(out).view(np.int64) if out else np.array([], np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """The parity of the hashes by their low bits; twice as many bits as members, a power of two, at least."""
    bits = min(MOST_BITS, max(64, 1 << (2 * len(hashes) - 1).bit_length())) if len(hashes) else 64
    ones = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(bool), bitorder="little").tobytes()


def folded(bits: bytes, words: int) -> np.ndarray:
    """A bitmap of fewer bits: its stretches, one upon the other."""
    own = np.frombuffer(bits, "<u8")
    return own if len(own) == words else np.bitwise_xor.reduce(own.reshape(-1, words), axis=0)


def signatures(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(node, n, keys, bits) of docs (node, text)."""
    ship(docs.sparkSession)

    def task(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            n, keys, bits = [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), size)
                n.append(len(own))
                keys.append(part_keys(own, num, den))
                bits.append(bitmap(own))
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys).astype(np.int64)))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), lists, pa.array(bits, pa.binary())], names=["node", "n", "keys", "bits"])

    return docs.select("node", "text").mapInArrow(task, "node long, n long, keys array<long>, bits binary")


def grouped_rows(batches, columns: list[str]):
    """Frames of whole groups of equal values in the first column, from batches in its order; a group may span batches."""
    held = None
    for batch in batches:
        now = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
        held = now if held is None else {c: np.concatenate((held[c], now[c])) for c in now}
        key = held[columns[0]]
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield {c: v[:cut] for c, v in held.items()}
            held = {c: v[cut:] for c, v in held.items()}
    if held is not None and len(held[columns[0]]):
        yield held


def buckets(sets: DataFrame) -> DataFrame:
    """(sig, part, nodes): the distinct groups of two or more nodes that share a key of sets (node, keys)."""

    def task(batches):
        seen: set[int] = set()
        for frame in grouped_rows(batches, ["key", "node"]):
            key, node = frame["key"], frame["node"]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node = key[new], node[new]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            first, size = first[size > 1], size[size > 1]
            if not len(first):
                continue
            many = np.add.reduceat(np.append(mixed(node.view(U)), U(0)), np.stack((first, first + size), 1).ravel())[::2]
            sig = mixed(many ^ size.astype(U)).view(np.int64)
            out = []
            for s, f, n in zip(sig.tolist(), first.tolist(), size.tolist(), strict=True):
                if s not in seen:
                    seen.add(s)
                    out += [(s, i // PART, n, node[f + i : f + min(n, i + PART)].tolist()) for i in range(0, n, PART)]
            for i in range(0, len(out), 1000):
                s, p, n, nodes = zip(*out[i : i + 1000], strict=True)
                yield pa.record_batch([pa.array(s, pa.int64()), pa.array(p, pa.int32()), pa.array(n, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], names=["sig", "part", "many", "nodes"])
            if len(seen) > 1 << 20:
                seen.clear()

    dealt = sets.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(task, "sig long, part int, many long, nodes array<long>").dropDuplicates(["sig", "part"])


def tiles(rows: DataFrame, group: str, load: str, most: int, num: int, den: int) -> DataFrame:
    """rows (group, node, n, ...) with key and side of each tile or pair of tiles that they belong to.

    A group of up to ``most`` by the sum of ``load`` is one tile (side -1). A larger one is cut by classes of size, and
    a class by hash; tiles of classes within the ratio meet, one as side 0, the other as side 1, and each meets itself.
    """
    width = math.log(den / num) / 2
    rows = rows.withColumn("size", F.floor(F.log("n") / F.lit(width)).cast("long"))
    sums = rows.groupBy(group, "size").agg(F.sum(load).alias("load"))
    large = sums.groupBy(group).agg(F.sum("load").alias("all"), F.collect_list(F.struct("size", F.ceil(F.col("load") / most).alias("k"))).alias("cut")).where(F.col("all") > most)
    large = saved(large.drop("all"))
    own = [c for c in rows.columns if c != "size"]
    whole = rows.join(large, group, "left_anti").select(*own, F.xxhash64(group, F.lit(0).cast("long"), F.lit(0).cast("long")).alias("key"), F.lit(-1).alias("side"))
    cut = rows.join(large, group).withColumn("mine", F.expr("size * 100000L + pmod(xxhash64(node), filter(cut, x -> x.size = size)[0].k)"))
    cut = cut.withColumn("other", F.explode(F.expr("flatten(transform(filter(cut, x -> abs(x.size - size) <= 3), x -> transform(sequence(0L, x.k - 1), s -> x.size * 100000L + s)))")))
    cut = cut.select(*own, F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), F.expr("case when mine = other then -1 when mine < other then 0 else 1 end").alias("side"))
    return whole.unionByName(cut)


def near_pairs(n: np.ndarray, bits: np.ndarray, side: np.ndarray, label: np.ndarray, num: int, den: int, block: int = 256):
    """Blocks (i, j) of positions in a tile, sorted by side and size, whose bitmaps are within the bound and whose labels differ."""
    words = min(len(b) for b in bits) // 8
    rows = np.stack([folded(b, words) for b in bits])
    two = int((side == 0).sum())
    for a in range(0, two or len(n), block):
        z = min(a + block, two or len(n))
        low = (two if two else a) + int(np.searchsorted(n[two or a :], -(-n[a] * num // den)))
        high = (two or a) + int(np.searchsorted(n[two or a :], n[z - 1] * den // num, side="right"))
        if low >= high or (label[low:high] == label[a]).all() and (label[a:z] == label[a]).all():
            continue
        differ = np.zeros((z - a, high - low), np.uint32)
        for w in range(words):
            differ += np.bitwise_count(rows[a:z, w, None] ^ rows[None, low:high, w])
        i, j = np.nonzero(differ <= np.maximum(allowed(n[a:z, None], n[None, low:high], num, den), -1).astype(np.int64))
        i, j = i + a, j + low
        apart = label[i] != label[j]
        if apart.any():
            yield i[apart], j[apart]


def forest(n: np.ndarray, bits: np.ndarray, side: np.ndarray, num: int, den: int):
    """Pairs (i, j) within the bound that join all that such pairs join."""
    label = np.arange(len(n))
    for i, j in near_pairs(n, bits, side, label, num, den):
        while len(i):
            high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
            trees, at = np.unique(high, return_index=True)  # each tree hooks on to one of a smaller label
            yield from zip(i[at].tolist(), j[at].tolist(), strict=True)
            up = np.arange(len(n))
            up[trees] = low[at]
            while (up != up[up]).any():
                up = up[up]
            label[:] = up[label]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]


def candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a forest of the pairs of each bucket whose bitmaps are within the bound. rows: (sig, node, n, bits)."""

    def task(batches):
        for frame in grouped_rows(batches, ["key", "side", "node", "n", "bits"]):
            key = frame["key"]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            out = []
            for f, z in zip(first, np.append(first[1:], len(key)), strict=True):
                node, n = frame["node"][f:z], frame["n"][f:z]
                if z - f == 2:
                    words = min(len(frame["bits"][f]), len(frame["bits"][f + 1])) // 8
                    differ = int(np.bitwise_count(folded(frame["bits"][f], words) ^ folded(frame["bits"][f + 1], words)).sum())
                    out += [(node[0], node[1])] if differ <= allowed(int(n[0]), int(n[1]), num, den) and min(n) * den >= max(n) * num else []
                elif z - f > 2:
                    out += [(node[i], node[j]) for i, j in forest(n, frame["bits"][f:z], frame["side"][f:z], num, den)]
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = tiles(rows.withColumn("one", F.lit(1).cast("long")), "sig", "one", TILE, num, den).select("key", "side", "node", "n", "bits")
    return dealt.repartition("key").sortWithinPartitions("key", "side", "n").mapInArrow(task, "a long, b long").distinct()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def links_of(a, b, num: int, den: int) -> bool:
    return overlap(a, b) * (num + den) >= num * (len(a) + len(b))


def checked(pairs: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) with linked: whether the sets (node, hashes) are similar enough."""

    def task(batches):
        for batch in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            own = [links_of(x.values.to_numpy(), y.values.to_numpy(), num, den) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.bool_())], names=["a", "b", "linked"])

    rows = pairs.join(arrays.withColumnsRenamed({"node": "a", "hashes": "x"}), "a").join(arrays.withColumnsRenamed({"node": "b", "hashes": "y"}), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(task, "a long, b long, linked boolean")


def left_over(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between nodes of one cluster whose labels differ. rows: (cluster, label, node, n, bits, hashes)."""

    def task(batches):
        for frame in grouped_rows(batches, ["key", "side", "node", "n", "label", "bits", "hashes"]):
            key = frame["key"]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            a, b = [], []
            for f, z in zip(first, np.append(first[1:], len(key)), strict=True):
                _, label = np.unique(frame["label"][f:z], return_inverse=True)
                name = np.concatenate([np.flatnonzero(label == k)[:1] for k in range(label.max() + 1)])
                label = name[label]  # positions
                for i, j in near_pairs(frame["n"][f:z], frame["bits"][f:z], frame["side"][f:z], label, num, den):
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        if label[x] != label[y] and links_of(frame["hashes"][f + x], frame["hashes"][f + y], num, den):
                            a.append(frame["node"][f + x])
                            b.append(frame["node"][f + y])
                            label[:] = joined_up(frame["node"], np.array([x]), np.array([y]), label)
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = tiles(rows, "cluster", "n", LOAD, num, den).select("key", "side", "node", "n", "label", "bits", "hashes")
    return dealt.repartition("key").sortWithinPartitions("key", "side", "n").mapInArrow(task, "a long, b long")


def hashes_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, hashes: sorted) of nodes (node, doc_id), from docs (doc_id, node, text)."""

    def task(batches):
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            own = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column(1)]
            own = [np.sort(x) for x in own]
            at = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(own)))], names=["node", "hashes"])

    nodes = broadcast_if_small(nodes.select("node", F.col("doc_id").alias("own")), MOST)
    rows = docs.join(nodes, "node").where(F.col("doc_id").eqNullSafe(F.col("own")))
    return saved(rows.select("node", "text").mapInArrow(task, "node long, hashes array<long>").dropDuplicates(["node"]))


def links(docs: DataFrame, classes: DataFrame, sets: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b): links that join all nodes of sets (node, n, keys, bits) that are similar enough, pair by pair."""
    bits = saved(sets.where("n > 0").select("node", "n", "bits").dropDuplicates(["node"]))
    groups = saved(buckets(sets))
    members = groups.select("sig", F.explode("nodes").alias("node")).join(bits, "node")
    pairs = saved(candidates(saved(members), num, den))
    used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    arrays = hashes_of(docs, saved(used.join(classes, "node")), size)
    told = saved(checked(pairs, arrays, num, den))
    good = told.where("linked").select("a", "b")
    failed = told.where("not linked")
    if failed.isEmpty():
        return good
    names = lambda root, name: arrays.select("node").join(root, "node", "left").select("node", F.coalesce("root", "node").alias(name))
    named = saved(names(connected(told), "cluster").join(names(connected(good), "label"), "node"))
    torn = named.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cluster")
    rows = named.join(torn, "cluster").join(bits, "node").join(arrays, "node")
    return good.unionByName(saved(left_over(saved(rows), num, den)))


def grouped(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(ascii_lower(F.coalesce("text", F.lit("")))).alias("node"))
    ids = saved(docs.select("doc_id", "node"))
    classes = saved(ids.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    copies = saved(ids.join(classes.withColumnRenamed("doc_id", "own"), "node").where(~F.col("doc_id").eqNullSafe(F.col("own"))).select("node", F.col("doc_id").alias("copy")).distinct())
    other = broadcast_if_small(copies.withColumnRenamed("node", "of"), MOST)
    firsts = docs.join(other, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("copy")), "left_anti")
    sets = saved(signatures(firsts, size, num, den))
    root = connected(links(docs, classes, sets, size, num, den))
    named = saved(root.join(classes, "node").groupBy("root").agg(F.min("doc_id").alias("least")))
    named = named.join(classes.withColumnRenamed("node", "root"), "root").select("root", F.least("least", "doc_id").alias("component_id"))
    inside = saved(root.join(named, "root").select("node", "component_id").unionByName(named.select(F.col("root").alias("node"), "component_id")))
    sizes = sets.groupBy("node").agg(F.max("n").alias("n_shingles")).join(classes, "node").join(inside, "node", "left")
    sizes = saved(sizes.select("node", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return ids.join(sizes, "node").select("doc_id", "n_shingles", own.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SIZE} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {SIZE - 2}), lambda i: array_to_string(ws[i:i + {SIZE - 1}], ' ')) END) AS s FROM w),
one AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {DEN} * count(*) >= {NUM} * (a.n + b.n - count(*))),
both_ AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, b.b FROM reach r JOIN both_ b ON b.a = r.other)
SELECT doc_id, n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) JOIN (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sets) USING (doc_id)
"""
