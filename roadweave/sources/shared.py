"""Tables written between the parts of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; on a single machine without it, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/roadweave-{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read back: what builds on it more than once doesn't compute it again, plans stay
    small, and a lost executor costs no more than what comes after."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
