"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staged(df: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder and read back: a cut of the lineage that survives lost executors."""
    path = work_folder(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; a temporary one, removed at exit, only in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/folioforge/{name}-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="folioforge-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}/{name}"
