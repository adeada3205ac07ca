"""Tables that a job writes for itself: lineage ends there, and what is read again is not computed again."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def folder(spark: SparkSession) -> str:
    """A folder below the shared one named by spark.checkpoint.dir; where that is unset, one of our own if driver and executors are one
    process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or _own_folder()).rstrip('/')}/tessera-core/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written and read back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
