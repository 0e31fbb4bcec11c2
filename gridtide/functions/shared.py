"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}  # folders of applications that name none


def new_path(spark: SparkSession) -> str:
    """A path of its own in the folder that spark.checkpoint.dir names; a session on one machine may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{found}/gridtide-{uuid.uuid4().hex}"
