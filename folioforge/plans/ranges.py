"""Date ranges: yearly chunks newest first, halving of saturated ones, and budgets over chunks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed


def year_chunks(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """ord, chunk_start, chunk_end: the years of each range, newest first, clamped to it."""
    years = F.posexplode(F.sequence(F.year(end), F.year(start), F.lit(-1)))
    rows = bounds.where(F.col(start) <= F.col(end)).select(F.col(start), F.col(end), years.alias("ord", "y"))
    return rows.select("ord", F.greatest(F.make_date("y", F.lit(1), F.lit(1)), start).alias("chunk_start"), F.least(F.make_date("y", F.lit(12), F.lit(31)), end).alias("chunk_end"))


def days(start: Column | str, end: Column | str) -> Column:
    return F.datediff(end, start) + 1


def halves(chunks: DataFrame) -> DataFrame:
    """Each chunk as its newer and its older half, in that order."""
    middle = F.date_add("chunk_start", (F.floor(days("chunk_start", "chunk_end") / 2) - 1).cast("int"))
    newer = F.struct(F.date_add(middle, 1).alias("chunk_start"), F.col("chunk_end"))
    older = F.struct(F.col("chunk_start"), middle.alias("chunk_end"))
    return chunks.select(F.posexplode(F.array(newer, older)).alias("half", "c")).select("half", "c.*")


def saturation(fetched: Column, limit: int = fixed.RESULT_LIMIT, least_days: int = fixed.MIN_SPLIT_DAYS) -> Column:
    """ok, warn_min_span, warn_same_year, or split."""
    full, wide = fetched >= limit, days("chunk_start", "chunk_end") > least_days
    spans_years = F.year("chunk_start") != F.year("chunk_end")
    return F.when(~full, "ok").when(~wide, "warn_min_span").when(~spans_years, "warn_same_year").otherwise("split")


def count_in(chunks: DataFrame, days_counted: DataFrame) -> DataFrame:
    """chunks with fetched: the rows dated within.  ``days_counted``: day, n; one row a day, so its size is bounded."""
    hit = (F.col("day") >= F.col("chunk_start")) & (F.col("day") <= F.col("chunk_end"))
    joined = chunks.join(F.broadcast(days_counted), hit, "left")
    return joined.groupBy("chunk_start", "chunk_end").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"))


def adaptive_split(spark: SparkSession, start: date, end: date, counted: Callable[[DataFrame], DataFrame], limit: int, least_days: int = fixed.MIN_SPLIT_DAYS) -> DataFrame:
    """Chunks of [start, end] that are under ``limit`` or cannot be halved: chunk_start, chunk_end, fetched, round.

    One aggregate job a round over all open chunks; the chunks themselves are few (days at most), and as a chunk of one
    day is never halved, a year is settled in ten rounds."""
    least_days = max(least_days, 1)
    open_ = year_chunks(spark.createDataFrame([(start, end)], "start date, end date")).select("chunk_start", "chunk_end")
    done: list[tuple] = []
    for k in count():
        rows = counted(open_).withColumn("_split", (F.col("fetched") >= limit) & (days("chunk_start", "chunk_end") > least_days)).collect()
        done += [(r["chunk_start"], r["chunk_end"], r["fetched"], k) for r in rows if not r["_split"]]
        todo = [(r["chunk_start"], r["chunk_end"]) for r in rows if r["_split"]]
        if not todo:
            break
        open_ = halves(spark.createDataFrame(todo, "chunk_start date, chunk_end date")).select("chunk_start", "chunk_end")
    return spark.createDataFrame(done, "chunk_start date, chunk_end date, fetched bigint, round int")


def batched_plan(chunks: DataFrame, days_counted: DataFrame, target: int, most: int = fixed.MOST_A_CALL, limit: int = fixed.RESULT_LIMIT, least_days: int = fixed.MIN_SPLIT_DAYS) -> DataFrame:
    """One round over chunks (ord, chunk_start, chunk_end): those begun before the new rows reach the target, each with
    fetched (at most ``most`` a call, known ones included), new, before (the new rows until then) and verdict.

    ``days_counted``: day, n, fresh (those not known); a row a day.  Chunks whose verdict is split make the next round
    with :func:`halves`."""
    hit = (F.col("day") >= F.col("chunk_start")) & (F.col("day") <= F.col("chunk_end"))
    order = Window.partitionBy("chunk_start", "chunk_end").orderBy(F.desc("day"))
    upto = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a call reads the newest first, up to its bound; a day that the bound cuts counts its known rows last
    days_ = chunks.join(F.broadcast(days_counted), hit, "left").withColumn("_room", F.greatest(F.lit(most) - upto, F.lit(0)))
    got = days_.groupBy("ord", "chunk_start", "chunk_end").agg(F.coalesce(F.sum(F.least("n", "_room")), F.lit(0)).alias("fetched"), F.coalesce(F.sum(F.least("fresh", "_room")), F.lit(0)).alias("new"))
    return within_budget(got, [F.col("ord")], "new", target).withColumn("verdict", saturation(F.col("fetched"), limit, least_days))


def within_budget(chunks: DataFrame, order: list[Column], new: str, target: int) -> DataFrame:
    """Chunks that are begun before the running total of new rows reaches the target; the last may overshoot.
    Chunks are few: planning rows, not data."""
    before = F.sum(new).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return chunks.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < target)
