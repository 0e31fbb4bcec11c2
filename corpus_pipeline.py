"""A corpus from raw documents: each stage takes (spark, docs, sf_dir) and returns the rows that it keeps.

Cases: rows are judged one by one, so null and repeated ids neither save a row nor condemn another. A null or empty text
has no language and goes with the first stage. Repeated rows are near-duplicates: one of them stays, that of the
smallest id, and rows without an id come last. An empty table gives an empty corpus. Further columns pass through all
stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridtide.llm import decontaminate, language_id, mixture, pii, simhash
from gridtide.llm.common import saved, scratch, table

STAGES = [
    ("language_id", language_id.stage),
    ("simhash", simhash.stage),
    ("decontaminate", decontaminate.stage),
    ("pii", pii.stage),
    ("mixture", mixture.stage),
]

#: Language identification is no SQL; tests/llm/test_pipeline.py runs the five stages again in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = saved(stage(spark, docs, sf_dir))
    return docs
