"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and
    the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gw-shared-")
    return f"{found.rstrip('/')}/gw-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df``, written and read back: what several plans read is made once, and a lost executor
    costs no more than the tasks it ran. The cluster clears the folder as it does checkpoints."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
