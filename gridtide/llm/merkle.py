"""A Merkle manifest of a table: nodes by level in Parquet, roots by source and over all, proofs by coordinate.

Each row is a leaf: the SHA-256 of its columns, each with its byte count, so that no two rows give one input. Leaves are
sorted by source and id into runs; every ``fan`` consecutive nodes of a source become one node of the next level, until
one node is left, the source's root. The sources' roots, in order of their names, become the root in the same way.

The node store is a folder with one Parquet table a level, sorted by (tree, pos) within its files: the coordinate of a
node is (level, tree, pos). A level is made by reading the one below once, in order, holding one run at a time; runs
that a file's edge cuts are completed by one small shuffle. Positions come from counts of (file, source), so no source
is sorted or counted in one task. Proofs go down the levels: a merge join by coordinate of each run with the path of its
parent; a path is written once for all leaves of its run and is as long as the tree is high.

Cases: a null value is ``-`` in its row's leaf; a null source is a source of its own, before all others; rows without an
id come first in their source; rows with one id are ordered by their digests, repeated rows are leaves of their own with
proofs of their own; an empty table has no root and gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.shipping import ship
from gridtide.llm.common import ascii_lower, broadcast_if_small, saved, shared_dir, table

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
MOST = 1_000_000
NODE = "tree string, pos long, n long, digest string"
SIDES = "array<struct<l: string, r: string>>"


def leaf_digest(values: dict[str, Column]) -> Column:
    """SHA-256 in hex of each value's byte count, a colon and the value, or - for null."""
    own = [v.cast("string") for v in values.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in own)), 256)


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None) -> DataFrame:
    """(doc_id, tree, leaf, other): other is the leaf of a row whose text was tampered with, as the caller says, or null."""
    own = {c: F.col(c) for c in columns}
    other = F.when(F.lit(False), F.lit("")) if tampered is None else F.when(tampered, leaf_digest(own | {"text": ascii_lower(F.col("text"))}))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))  # sorts as the sources do, null first
    return docs.select("doc_id", tree.alias("tree"), leaf_digest(own).alias("leaf"), other.alias("other"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos (place within the tree, from 0, by order) and n (rows of the tree), sorted by them within files."""
    own = rows.columns
    rows = saved(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("id", F.monotonically_increasing_id()))
    rows = rows.withColumn("file", F.shiftright("id", 33))
    counts = rows.groupBy("tree", "file").agg(F.count("*").alias("here"), F.min("id").alias("first"))
    before = F.sum("here").over(Window.partitionBy("tree").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({"before": F.coalesce(before, F.lit(0)), "n": F.sum("here").over(Window.partitionBy("tree"))})
    counts = saved(counts.select("tree", "file", (F.col("before") - F.col("first")).alias("shift"), "n"))
    return rows.join(broadcast_if_small(counts, MOST), ["tree", "file"]).select(*own, (F.col("id") + F.col("shift")).alias("pos"), "n")


def risen(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """The next level of nodes (tree, pos, n, digest); nodes is read in order, one run held at a time."""
    ship(nodes.sparkSession)

    def task(batches):
        def closed(key, n, parts):
            if len(parts) == min(fan, n - key[1] * fan):
                yield key[0], key[1], n, hashlib.sha256("".join(d for _, d in sorted(parts)).encode()).hexdigest(), True
            else:
                yield from ((key[0], p, n, d, False) for p, d in parts)

        names = ["tree", "pos", "n", "digest", "whole"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        key, size, parts = None, 0, []
        for batch in batches:
            out = []
            for tree, pos, n, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (tree, pos // fan):
                    out += closed(key, size, parts) if parts else ()
                    key, size, parts = (tree, pos // fan), n, []
                parts.append((pos, digest))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)
        if parts:
            out = list(closed(key, size, parts))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    read = saved(nodes.select("tree", "pos", "n", "digest").mapInArrow(task, NODE + ", whole boolean"))
    cut = read.where("not whole").groupBy("tree", F.floor(F.col("pos") / fan).alias("pos"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("run"))
    cut = cut.select("tree", "pos", "n", F.sha2(F.array_join(F.col("run.digest"), ""), 256).alias("digest"))
    return read.where("whole").drop("whole").unionByName(cut).withColumn("n", F.ceil(F.col("n") / fan))


class Store:
    """The nodes by level: ``path/level=k`` has (tree, pos, n, digest); level 0 has the leaves with their own columns."""

    def __init__(self, path: str, first: DataFrame, fan: int = FAN):
        self.path, self.fan, self.levels = path, fan, []
        self._add(first)
        while self.levels[-1].where("n > 1").limit(1).count():
            self._add(risen(self.levels[-1].where("n > 1"), fan))

    def _add(self, nodes: DataFrame) -> None:
        to = f"{self.path}/level={len(self.levels)}"
        nodes.write.parquet(to)
        self.levels.append(nodes.sparkSession.read.schema(nodes.schema).parquet(to))

    def roots(self) -> DataFrame:
        """(tree, digest) of each tree's last node."""
        out = [x.where("n = 1").select("tree", "digest") for x in self.levels]
        for x in out[1:]:
            out[0] = out[0].unionByName(x)
        return out[0]

    def paths(self, roots: DataFrame, own: list[str]) -> DataFrame:
        """own columns of the leaves, what roots (tree, ..., path) has, and path: (l, r), what a run has left and right of the node, level by level."""
        kept = [c for c in roots.columns if c not in ("tree", "path")]
        upper = None
        for level, nodes in reversed(list(enumerate(self.levels))):
            has = own if level == 0 else []
            lone = nodes.where("n = 1").join(roots, "tree").select("tree", "pos", *has, *kept, "path")
            if upper is None:
                upper = lone
                continue
            run = F.sort_array(F.collect_list(F.struct("pos", "digest", *has)))
            runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("pos") / self.fan).alias("up")).agg(run.alias("run"))
            runs = runs.join(upper.withColumnRenamed("pos", "up"), ["tree", "up"]).withColumn("all", F.array_join(F.col("run.digest"), ""))
            sides = F.expr("struct(left(`all`, 64 * i) as l, substring(`all`, 64 * i + 65) as r)")
            each = runs.select("tree", *kept, "path", "all", F.posexplode("run").alias("i", "x"))
            each = each.select("tree", "x.pos", *(F.col(f"x.{c}").alias(c) for c in has), *kept, F.concat(F.array(sides), "path").alias("path"))
            upper = lone.unionByName(each)
            upper = upper if level == 0 else saved(upper)
        return upper


def manifest(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """rows (doc_id, tree, leaf, other: of :func:`leaves`) with subroot, root and path."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/gridtide-{uuid.uuid4().hex}"
    store = Store(f"{path}/rows", placed(rows, ["doc_id", "leaf"]).withColumn("digest", F.col("leaf")), fan)
    subroots = saved(store.roots())
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = Store(f"{path}/sources", placed(tops, ["name"]), fan)
    root = top.roots().select("tree", F.col("digest").alias("root"), F.expr(f"cast(array() as {SIDES})").alias("path"))
    own = top.paths(root, ["name"]).join(subroots.withColumnRenamed("tree", "name"), "name")
    return store.paths(saved(own.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")), ["doc_id", "leaf", "other"])


def proof(path: str = "path") -> Column:
    """SHA-256 of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda own, x: F.sha2(F.concat(x["l"], own, x["r"]), 256))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = manifest(saved(leaves(docs, tampered=tampered)))
    out = out.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), folded(F.coalesce("other", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


DEPTH = 5  # levels that the SQL writes out: up to FAN ** DEPTH rows a source
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in COLUMNS) + ")"
_OTHER = _LEAF.replace("CAST(text AS VARCHAR)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _levels(t: str) -> str:
    """CTEs t1 to tDEPTH above t0 (tree, pos, n, d), and the runs of each level."""
    out = []
    for k in range(DEPTH):
        out.append(f"{t}r{k} AS (SELECT tree, pos // {FAN} AS up, any_value(n) AS n, list(d ORDER BY pos) AS run FROM {t}{k} GROUP BY tree, pos // {FAN})")
        out.append(f"{t}{k + 1} AS (SELECT tree, up AS pos, CAST(ceil(n / {FAN}.0) AS BIGINT) AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d FROM {t}r{k})")
    return ",\n".join(out)


def _climb(t: str, pos: str, n: str, leaf: str, name: str) -> tuple[str, str]:
    """Columns that fold leaf up the tree (the last is nameDEPTH), and the expression of all siblings."""
    cols, siblings = [], []
    for k in range(DEPTH):
        i = f"({pos} // {FAN**k}) % {FAN}"
        left, right = f"array_to_string({t}r{k}.run[1:{i}], '')", f"array_to_string({t}r{k}.run[{i} + 2:], '')"
        below = f"{name}{k}" if k else leaf
        cols.append(f"CASE WHEN {n} > {FAN**k} THEN sha256({left} || {below} || {right}) ELSE {below} END AS {name}{k + 1}")
        siblings.append(f"{left} || {right}")
    return ", ".join(cols), " || ".join(siblings)


def _runs(t: str, tree: str, pos: str) -> str:
    return " ".join(f"JOIN {t}r{k} ON {t}r{k}.tree = {tree} AND {t}r{k}.up = {pos} // {FAN ** (k + 1)}" for k in range(DEPTH))


_OWN, _OWN_SIBLINGS = _climb("t", "b.pos", "b.n", "coalesce(b.other, b.leaf)", "f")
_TOP, _TOP_SIBLINGS = _climb("s", "s0.pos", "s0.n", f"f{DEPTH}", "g")
SQL = f"""
WITH rows_ AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {_LEAF} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_OTHER} END AS other FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
t0 AS (SELECT tree, pos, n, leaf AS d FROM b),
{_levels("t")},
s0 AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, d FROM t{DEPTH}),
{_levels("s")}
SELECT b.doc_id, b.leaf, s0.d AS subroot, s{DEPTH}.d AS root, {_OWN}, {_TOP}, sha256({_OWN_SIBLINGS} || {_TOP_SIBLINGS}) AS proof_sha256
FROM b {_runs("t", "b.tree", "b.pos")} JOIN s0 ON s0.name = b.tree {_runs("s", "''", "s0.pos")} CROSS JOIN s{DEPTH}
"""
SQL = f"SELECT doc_id, leaf, subroot, root, proof_sha256, g{DEPTH} AS folded_root, g{DEPTH} = root AS verified FROM ({SQL})"
