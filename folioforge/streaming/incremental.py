"""Incremental processing: what is new since the last run, once, with latest-wins upserts.

A checkpointed file stream takes the place of a processed flag; a run with what is there and then
ends (``availableNow``) is the batch loop's counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import store
from ..operators.ordered import first_wins


def run_available(spark: SparkSession, source: str, schema: StructType, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand each new batch of files to ``handle`` once the run's start; files of earlier runs are not seen again."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_latest(table: str, key: str, version: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes a batch's latest row of each key under the batch's number: a batch that is run again
    writes the same place again.  :func:`latest` reads the table."""

    def handle(batch: DataFrame, number: int) -> None:
        first_wins(batch, [key], [F.col(version).desc()]).withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return handle


def compact(spark: SparkSession, table: str, key: str, version: str) -> None:
    """Make the latest rows of all batches a snapshot, after which :func:`latest` reads it and the batches since.

    Batches stay until they are cleaned; one that is run again writes the same rows, which lose or tie."""
    upto = spark.read.parquet(table).agg(F.max("batch")).first()[0]
    store.replace(spark, latest(spark, table, key, version, keep=True).withColumn("_upto", F.lit(upto).cast("bigint")), f"{table}_compact")


def latest(spark: SparkSession, table: str, key: str, version: str, keep: bool = False) -> DataFrame:
    """Each key's latest row, from the last snapshot and the batches after it (their folders alone are read)."""
    rows = spark.read.parquet(table)
    if store.exists(spark, f"{table}_compact"):
        base = store.current(spark, f"{table}_compact")
        upto = base.agg(F.max("_upto")).first()[0]
        rows = rows.where(F.col("batch") > (-1 if upto is None else upto)).drop("batch").unionByName(base.drop("_upto"))
    got = first_wins(rows, [key], [F.col(version).desc(), F.col("_batch").desc()]).drop("batch")
    return got if keep else got.drop("_batch")
