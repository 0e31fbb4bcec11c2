"""Weights between boxes of which many are equal: those are worked out once, and the results are those of SQL."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridtide.plans import catalog
from tests.oracle import TABLES, connect, same

SF = "/root/testdata/sf0.001"
COPIES = 60


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """The smallest tables, but each customer and part COPIES times with the same box (boxes repeat after 2100 keys), some
    keys more than once."""
    d = tmp_path_factory.mktemp("copies")
    for name in TABLES:
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        if name in ("customer", "part"):
            key = rows.columns[0]
            rows = rows.crossJoin(spark.range(COPIES)).withColumn(key, F.col(key) + 2100 * F.col("id")).drop("id")
            rows = rows.unionByName(rows.where(F.col(key) % 37 == 3)).unionByName(rows.where(F.col(key) == 11))
        rows.coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def rows_made(df) -> dict[str, list[int]]:
    """By kind of node of the plan that ran, the rows that came out of it, or that it wrote for a shuffle."""
    made = defaultdict(list)

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        metrics = node.metrics()
        for m in ("numOutputRows", "shuffleRecordsWritten"):
            if metrics.contains(m):
                made[name.split(" ")[0]].append(metrics.apply(m).value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return made


def checked(spark, copies, name: str) -> tuple[int, dict[str, list[int]]]:
    """Rows of a query that are those of SQL, and what its nodes made."""
    con = connect(copies)
    for t in TABLES:
        con.sql(f"create or replace view {t} as select * from '{copies}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, copies)
    return same(df, con, catalog.ORACLE[name]), rows_made(df)


def test_conserving_weights_of_equal_boxes(spark, copies):
    n, made = checked(spark, copies, "regrid_weights_conservative")
    assert n > 60_000 and max(made["Exchange"]) < n / 4  # pairs of boxes are not shuffled


def test_overlaps_of_equal_boxes(spark, copies):
    n, made = checked(spark, copies, "overlap_weights")
    assert n > 60_000 and max(made["Generate"]) < 9 * 2100  # different boxes, by the squares that they touch


def test_weights_of_equal_targets(spark, copies):
    n, made = checked(spark, copies, "regrid_weights")
    assert n > 60_000 and max(made["Exchange"]) < n / 4  # pairs of boxes are not shuffled


def test_field_on_equal_targets(spark, copies):
    n, made = checked(spark, copies, "regrid_apply")
    assert n > 900 and max(max(made[k]) for k in made if "Join" in k) < 20_000  # the 66 000 pairs of boxes are not made
