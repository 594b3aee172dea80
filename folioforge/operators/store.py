"""Idempotent maintenance of record tables: insert-ignore, latest-wins, invalidation, evolution, routing.

Every operator gives the table's next snapshot (or the rows to add) as a DataFrame; :func:`replace`
writes a snapshot beside the old one and points to it, so a reader never sees half of it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ..functions import fixed, text
from .ordered import first_wins


def insert_ignore(target: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of ``new`` to append: the first of each key that the target does not have."""
    return first_wins(new, [key], order).join(target.select(key), key, "left_anti")


def replace_latest(target: DataFrame, new: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The target, which has one row a key, with each key's latest row of both; of equal versions the new one.

    What is compared is keys and versions alone: the target's rows are not sorted, and a batch that can be broadcast
    does not shuffle them."""
    best = first_wins(new, [key], [F.col(v).desc() for v in version])
    old = target.select(F.col(key).alias("_key"), F.struct(*version).alias("_old"))
    wins = best.join(old, F.col(key) == F.col("_key"), "left").where(F.col("_old").isNull() | (F.struct(*version) >= F.col("_old"))).drop("_key", "_old")
    return target.join(wins.select(key), key, "left_anti").unionByName(wins, allowMissingColumns=True)


def schema(columns: list[tuple[str, str]]) -> StructType:
    kinds = {"bigint": LongType(), "int": IntegerType(), "string": StringType(), "timestamp": TimestampType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in columns])


#: The tables of fetched pages and of parsed judgments.
CRAWL_RECORDS = schema(fixed.CRAWL_RECORDS)
JUDGMENTS = schema([("id", "bigint"), ("crawl_id", "bigint"), *[(c, "string") for c in fixed.JUDGMENT_FIELDS], ("parsed_at", "timestamp")])


def exists(spark: SparkSession, table: str) -> bool:
    """Whether a snapshot was ever made current; a table that is there and cannot be read is an error."""
    try:
        current(spark, table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def create_if_absent(spark: SparkSession, table: str, columns: StructType) -> DataFrame:
    """The table's current snapshot, an empty one if there was none."""
    if not exists(spark, table):
        replace(spark, spark.createDataFrame([], columns), table)
    return current(spark, table)


def count_like(records: DataFrame, keyword: str, column: str = "keyword") -> DataFrame:
    """n: the records whose column is LIKE the keyword, wildcards and all."""
    return records.where(text.like_any(keyword, column)).agg(F.count(F.lit(1)).alias("n"))


def of_file(records: DataFrame, html_file: Column | str) -> DataFrame:
    """id of the records of a file."""
    return records.where(F.col("html_file") == html_file).select("id")


def judgments_of(records: DataFrame, judgments: DataFrame) -> DataFrame:
    """Each record with its judgment, if it has been parsed: both have one row an id."""
    return records.join(judgments, records["id"] == judgments["crawl_id"], "left")


def reset(records: DataFrame) -> DataFrame:
    """All records as not parsed; a full rebuild parses them into an empty table."""
    return records.withColumn("parsed", F.lit(0))


def mark_parsed(records: DataFrame, judgments: DataFrame) -> DataFrame:
    """``parsed`` follows from the judgments that are there, so it cannot disagree with them."""
    done = judgments.select(F.col("crawl_id").alias("_done")).distinct()
    return records.drop("parsed").join(done, F.col("id") == F.col("_done"), "left").withColumn("parsed", F.col("_done").isNotNull().cast("int")).drop("_done")


def mark_recrawled(records: DataFrame, fetched: DataFrame) -> DataFrame:
    """Records with the file of a new fetch (case_number, html_file, crawled_at), no longer parsed."""
    f = fetched.select("case_number", F.col("html_file").alias("_file"), F.col("crawled_at").alias("_at"))
    hit = F.col("_file").isNotNull()
    joined = records.join(f, "case_number", "left")
    out = {"html_file": F.when(hit, F.col("_file")).otherwise(F.col("html_file")), "crawled_at": F.when(hit, F.col("_at")).otherwise(F.col("crawled_at")), "parsed": F.when(hit, F.lit(0)).otherwise(F.col("parsed"))}
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in records.columns])


def evolve(df: DataFrame, columns: list[str], default: str = "") -> DataFrame:
    """With the columns it lacks, filled by a default; what is there stays."""
    return df.withColumns({c: F.lit(default) for c in columns if c not in df.columns}) if set(columns) - set(df.columns) else df


def unprocessed(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return records.join(done.select(key).distinct(), key, "left_anti")


def route(items: DataFrame, records: DataFrame, key: str, complete: Column) -> DataFrame:
    """items with action: skip (there and complete), recrawl (there, not complete), insert (not there)."""
    there = records.withColumn("_there", F.lit(True)).withColumn("_complete", complete).select(key, "_there", "_complete")
    action = F.when(F.col("_there").isNull(), "insert").when(F.col("_complete"), "skip").otherwise("recrawl")
    return items.join(there, key, "left").withColumn("action", action).drop("_there", "_complete")


def stubs(records: DataFrame, files: DataFrame, complete: Column) -> DataFrame:
    """Records with an address whose file (html_file, html) is missing or incomplete: with reason."""
    known = records.where("source_url IS NOT NULL AND source_url <> ''")
    joined = known.join(files.withColumn("_ok", complete).select("html_file", "_ok"), "html_file", "left")
    return joined.where(~F.coalesce("_ok", F.lit(False))).withColumn("reason", F.when(F.col("_ok").isNull(), "missing").otherwise("incomplete")).drop("_ok")


def recrawl(records: DataFrame, files: DataFrame, complete: Column, fetched: DataFrame) -> DataFrame:
    """Records after a new fetch (case_number, html_file, crawled_at, html) of those whose page was missing or incomplete:
    where the new page is complete it takes the old one's place and waits to be parsed; everything else is as it was."""
    again = stubs(records, files, complete).select("case_number")
    better = fetched.withColumn("_ok", complete).where("_ok").drop("_ok").join(again, "case_number", "left_semi")
    return mark_recrawled(records, better)


def to_retry(rejects: DataFrame, key: str, most: int = 3) -> DataFrame:
    """key, attempts of what was rejected fewer than ``most`` times: it is tried again, the rest is given up."""
    return rejects.groupBy(key).agg(F.count(F.lit(1)).alias("attempts")).where(F.col("attempts") < most)


def replace(spark: SparkSession, snapshot: DataFrame, table: str) -> str:
    """Write a snapshot under ``table`` and make it current; the one before stays until it is cleaned."""
    name = uuid.uuid4().hex
    snapshot.write.parquet(f"{table}/{name}")
    spark.createDataFrame([(name,)], "snapshot string").withColumn("made_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{table}/_current")
    return name


def current(spark: SparkSession, table: str) -> DataFrame:
    name = spark.read.parquet(f"{table}/_current").orderBy(F.desc("made_at")).first()["snapshot"]
    return spark.read.parquet(f"{table}/{name}")
