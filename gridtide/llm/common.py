"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.shipping import ship

_OWN: dict[str, str] = {}  # folders of applications that name none
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)  # tables saved within scratch
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Where that is unset, a session on one machine (as in tests) gets a temporary folder; a cluster gets an error, since
    its executors would not see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[application]


def saved(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridtide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes what :func:`saved` writes within, but for the last table, the result; after an error that too.

    Each thread has its own list, so queries side by side leave each other's tables alone.
    """
    outer, own = _SCOPE.get(), []
    token = _SCOPE.set(own)
    kept: list[str] = []
    try:
        yield
        kept = own[-1:]
    finally:
        _SCOPE.reset(token)
        if outer is not None:
            outer.extend(kept)
        for path in own[: len(own) - len(kept)]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def batches_of(spark, rows: int):
    """Arrow batches of at most so many rows for the jobs within: whole texts and segments are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(held)) if int(held) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, held)


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table with a number for each row, and the name of that column: ids may be null or repeated, rows not."""
    name = "_row"
    while name in df.columns:
        name += "_"
    return saved(df.withColumn(name, F.monotonically_increasing_id())), name


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def n_bytes(df: DataFrame):
    """About the bytes of a row of df."""
    text = [F.coalesce(F.octet_length(F.col(f"`{c}`") if kind in ("string", "binary") else F.to_json(F.struct(f"`{c}`"))), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    return sum(text, F.lit(8 * len(df.columns)).cast("long"))


def broadcast_if_small(df: DataFrame, most_rows: int, most_bytes: int = 128 << 20) -> DataFrame:
    """Hint a broadcast only where df has been counted, and rows and bytes are within the bounds; else Spark shuffles."""
    rows, size = df.agg(F.count("*"), F.sum(n_bytes(df))).first()
    return F.broadcast(df) if rows <= most_rows and (size or 0) <= most_bytes else df.hint("merge")


def remainder(col, n: int):
    """crc32 of the id as text, modulo n: the split into training and held-out rows."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def without(df: DataFrame, rows: DataFrame, key: str, most_rows: int = 2_000_000) -> DataFrame:
    """df without the rows whose key (of :func:`keyed`) is in rows, and without the key itself."""
    own = [c for c in df.columns if c != key]
    return df.join(broadcast_if_small(rows.select(key).distinct(), most_rows), key, "left_anti").select(*own)
