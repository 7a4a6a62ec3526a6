"""Tables written between steps, so that a lost executor costs a read and not the whole plan."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def writer(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table below spark.checkpoint.dir and reads it again.

    Where that setting is unset and Spark runs in one process, as in tests, a temporary folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")

    def save(df: DataFrame) -> DataFrame:
        path = f"{base}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save
