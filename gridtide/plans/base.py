"""The driver's tables as gridded series, in Spark and in SQL, and the register of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.calendar import month_number, seconds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Registers a function of (spark, sf_dir) with the SQL that gives the same rows; SQL starts after the CTEs."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = untied(with_tables(sql))
        return f

    return add


#: Added before rounding on both sides: sums of cents over a million often end half way between two sixth decimals,
#: where the order of a sum would decide.
NUDGE = 3e-10


def untied(sql: str) -> str:
    """sql with NUDGE added to whatever is rounded."""
    out, at = "", 0
    while (k := sql.find("round(", at)) >= 0:
        depth, comma, z = 0, k, k + 6
        while depth >= 0:
            c = sql[z]
            depth += (c == "(") - (c == ")")
            comma = z if c == "," and depth == 0 else comma
            z += 1
        out += sql[at : k + 6] + "(" + untied(sql[k + 6 : comma]) + f") + {NUDGE}" + sql[comma:z]
        at = z
    return out + sql[at:]


#: Named subqueries that the SQL may use; those that a statement names are put before it.
TABLES = {
    "d1": "SELECT s_nationkey AS cell, l_returnflag AS forc, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS m, sum(l_extendedprice) / 1e6 AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3",
    "d2": "SELECT o_orderpriority AS series, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS m, sum(o_totalprice) / 1e6 AS x FROM orders GROUP BY 1, 2",
    "d2t": "SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS m, sum(o_totalprice) / 1e6 AS x FROM orders GROUP BY 1",
    "ev": "SELECT event_id, user_id, event_type AS type, CAST(floor(epoch(ts)) AS BIGINT) AS s, value FROM events",
    "ar": "SELECT vec_id, label, CAST(p AS INTEGER) AS p, CAST(embedding[p + 1] AS DOUBLE) AS x FROM embeddings, unnest(range(0, 64)) AS u(p)",
    "pt": "SELECT c_custkey AS point, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) + 0.25 AS lon, CAST((c_custkey * 17) % 160 - 80 AS DOUBLE) + 0.125 AS lat FROM customer",
    "ce": "SELECT s_suppkey AS cell, CAST((s_suppkey * 53) % 360 - 180 AS DOUBLE) AS lon, CAST((s_suppkey * 29) % 160 - 80 AS DOUBLE) AS lat, CASE WHEN s_suppkey % 7 <> 0 THEN 1 ELSE 0 END AS wet, 1.0 + s_suppkey % 5 AS area, s_nationkey AS nation FROM supplier",
    "fc": "SELECT s_nationkey AS cell, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS init, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS pred, sum(l_extendedprice) / 1e6 AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate >= o_orderdate AND date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) < 180 GROUP BY 1, 2, 3",
    "sens": "SELECT n_nationkey AS cell, CAST(lag AS BIGINT) AS lag, exp(-lag / 6.0) * cos(0.1 * n_nationkey) AS w FROM nation, unnest(range(0, 6)) AS u(lag)",
    "an": "SELECT *, x - avg(x) OVER (PARTITION BY cell, forc, m % 12) AS anom FROM d1",
    "imp": "SELECT an.cell, forc, m + lag AS m, lag, w * anom AS impact FROM an JOIN sens USING (cell)",
    "reg": "SELECT n_nationkey AS cell, n_regionkey AS region FROM nation",
}


def with_tables(sql: str) -> str:
    import re

    used: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(TABLES[name])
                used.append(name)

    own = re.findall(r"(?:WITH|,)\s*(\w+)\s+AS\s*\(", sql)
    need(sql)
    ctes = ", ".join(f"{n} AS ({TABLES[n]})" for n in used if n not in own)
    if not ctes:
        return sql
    return f"WITH {ctes}, " + sql.strip()[4:] if sql.strip().startswith("WITH") else f"WITH {ctes} {sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forcing(spark, d: str) -> DataFrame:
    """(cell, forc, m, x): monthly sums by nation of the supplier."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("s_nationkey").alias("cell"), F.col("l_returnflag").alias("forc"), month_number("l_shipdate").alias("m")).agg((F.sum("l_extendedprice") / 1e6).alias("x"))


def reference(spark, d: str) -> DataFrame:
    """(series, m, x)."""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), month_number("o_orderdate").alias("m")).agg((F.sum("o_totalprice") / 1e6).alias("x"))


def total(spark, d: str) -> DataFrame:
    """(m, x)."""
    return table(spark, d, "orders").groupBy(month_number("o_orderdate").alias("m")).agg((F.sum("o_totalprice") / 1e6).alias("x"))


def events(spark, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("type"), seconds("ts").alias("s"), "value")


def arrays(spark, d: str) -> DataFrame:
    """(vec_id, label, p, x)."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "x")).withColumn("x", F.col("x").cast("double"))


def points(spark, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("point"), ((k * 37) % 360 - 180).cast("double").alias("lon") + 0.25, (((k * 17) % 160 - 80).cast("double") + 0.125).alias("lat")).toDF("point", "lon", "lat")


def cells(spark, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    lon, lat = ((k * 53) % 360 - 180).cast("double"), ((k * 29) % 160 - 80).cast("double")
    return table(spark, d, "supplier").select(k.alias("cell"), lon.alias("lon"), lat.alias("lat"), F.when(k % 7 != 0, 1).otherwise(0).alias("wet"), (1.0 + k % 5).alias("area"), F.col("s_nationkey").alias("nation"))


def forecast(spark, d: str) -> DataFrame:
    """(cell, init, pred, x): shipments within 180 days of their order."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.where((F.col("l_shipdate") >= F.col("o_orderdate")) & (F.datediff("l_shipdate", "o_orderdate") < 180))
    return rows.groupBy(F.col("s_nationkey").alias("cell"), month_number("o_orderdate").alias("init"), month_number("l_shipdate").alias("pred")).agg((F.sum("l_extendedprice") / 1e6).alias("x"))


def sensitivity(spark, d: str) -> DataFrame:
    """(cell, lag, w)."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("lag"))
    return rows.withColumn("w", F.exp(-F.col("lag") / 6.0) * F.cos(0.1 * F.col("cell")))


def region_of(spark, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("cell"), F.col("n_regionkey").alias("region"))


def rnd(c, digits: int = 6):
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, digits)


def r6(c: str, digits: int = 6):
    return rnd(c, digits).alias(c)
