"""Connected components of a link table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(b as decimal(38, 0)))")).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b: longs) but the roots themselves; root is its component's smallest id.

    Each round is written to the shared folder, so that plans stay short and lost executors cost one round. Rows with a
    null end and loops are no links. An empty table has no components.
    """
    links = edges.where("a is not null and b is not null and a <> b")
    links = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        centre = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(centre, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = saved(small.unionByName(centre.select("a", F.col("m").alias("b"))).distinct())
        now = _state(links)
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
