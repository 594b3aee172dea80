"""Operators whose result depends on an order: first wins, budgets, early stop, islands, forward fill.

Windows are always by a key.  Where an order spans all rows, or very many rows of a key, they are
dealt into stretches of the order first, so that no single task gets them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, keys, [F.col(o).desc() for o in order])


def _meet(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the further columns of ``few``, which has a row for each value of the keys; null meets null."""
    few = few.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in few.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(few, same).drop(*[f"_k{i}" for i in range(len(keys))])


def row_index(df: DataFrame, order: list[Column | str], stretch: Column, name: str = "row_index", by: list[str] | None = None) -> DataFrame:
    """A 0-based number in the order, within each value of the columns ``by`` if given.  ``stretch`` must not decrease
    along the order; rows are numbered within stretches, and the stretches' counts (a row each) are summed up before."""
    by = by or []
    keys = [*by, "_stretch"]
    rows = df.withColumn("_stretch", stretch)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    along = (Window.partitionBy(*by) if by else Window).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_size").over(along), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return _meet(rows.withColumn("_in", inside), starts, keys).withColumn(name, (F.col("_start") + F.col("_in")).cast("bigint")).drop("_stretch", "_in", "_start")


def batches(df: DataFrame, order: list[Column | str], stretch: Column, size: int = 80, name: str = "batch") -> DataFrame:
    """Which session of ``size`` rows each row falls in."""
    return row_index(df, order, stretch, "_index").withColumn(name, F.floor(F.col("_index") / size).cast("bigint")).drop("_index")


def budget_prefix(df: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows; each task passes on no more than that many."""
    return df.orderBy(*order).limit(most)


def early_stop(items: DataFrame, group: str, page: str, year: str, low: int, high: int) -> DataFrame:
    """The items in range of pages up to a group's first page without any in range whose latest year is before ``low``."""
    inside = F.col(year).isNull() | F.col(year).between(low, high)
    pages = items.groupBy(group, page).agg(F.max(inside.cast("int")).alias("_any"), F.max(year).alias("_latest"))
    stop = pages.where((F.col("_any") == 0) & (F.col("_latest") < low)).groupBy(group).agg(F.min(page).alias("_stop"))
    return items.where(inside).join(stop, group, "left").where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_stop")


def distribution(df: DataFrame, key: str, order: str, unknown: str) -> DataFrame:
    """value, n: counts by value, null and empty as ``unknown``; most frequent first, ties by first appearance."""
    value = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(unknown))
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at")).orderBy(F.desc("n"), "first_at")


def distributions(df: DataFrame, keys: list[str], order: str, unknown: str) -> DataFrame:
    """attribute, value, n, first_at for several attributes in one pass."""
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(unknown)).alias("value")) for k in keys]))
    return df.select(F.col(order).alias("_o"), pair.alias("p")).groupBy("p.attribute", "p.value").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("first_at"))


def forward_fill(df: DataFrame, key: str, order: list[str], value: Column, name: str, stretch: Column | None = None) -> DataFrame:
    """The last value that was not null up to each row of its key.

    With ``stretch``, which must not decrease along the order, a key's rows are filled stretch by stretch, and
    each stretch's last value (a row each) is carried into the ones after it."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    if stretch is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(*upto)))
    rows = df.withColumn("_stretch", stretch).withColumn("_value", value)
    at = F.when(F.col("_value").isNotNull(), F.struct(*order))
    ends = rows.groupBy(key, "_stretch").agg(F.max_by("_value", at).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(*upto))
    met = _meet(rows.withColumn("_inside", inside), ends.select(key, "_stretch", before.alias("_before")), [key, "_stretch"])
    return met.withColumn(name, F.coalesce("_inside", "_before")).drop("_stretch", "_value", "_inside", "_before")


def titled_sections(lines: DataFrame, key: str, pos: str, line: str, is_heading: Column) -> DataFrame:
    """key, section (0 before the first heading), title, text: lines from each heading to the next, joined by newlines."""
    number = F.sum(is_heading.cast("int")).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumn("_head", is_heading).withColumn("section", number.cast("bigint"))
    got = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct(F.col(pos).alias("p"), F.col(line).alias("t"))))), lambda x: x["t"])
    return rows.groupBy(key, "section").agg(F.max(F.when(F.col("_head"), F.col(line))).alias("title"), F.array_join(got, "\n").alias("text"))


def islands(lines: DataFrame, key: str, pos: str, line: str, is_fragment: Column) -> DataFrame:
    """Runs of fragments glued to the line that ends them: key, island, text."""
    ended = F.sum((~is_fragment).cast("int")).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("island", F.coalesce(ended, F.lit(0)).cast("bigint"))
    got = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(line).alias("t")))), lambda x: x["t"])
    return rows.groupBy(key, "island").agg(F.array_join(got, "").alias("text"))


def roles_joined(rows: DataFrame, key: str, pos: str, role: str, name: Column) -> DataFrame:
    """key, roles: "role：name、name" of each role in the order of first appearance, joined by "；"."""
    by_role = rows.groupBy(key, role).agg(F.min(pos).alias("_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), name.alias("n")))), lambda x: x["n"]), "、").alias("_names"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("_at").alias("a"), F.concat(F.col(role), F.lit("："), F.col("_names")).alias("t"))))
    return by_role.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "；").alias("roles"))


def last_match_window(df: DataFrame, key: str, at: str, is_match: Column, back: Column) -> DataFrame:
    """Rows of a key from ``back`` before its last match on; keys without a match have none.

    A partial maximum and a join, so a key with very many rows is split by adaptive execution."""
    last = df.groupBy(key).agg(F.max(F.when(is_match, F.col(at))).alias("_last")).where("_last IS NOT NULL")
    return _meet(df, last, [key]).where(F.col(at) >= F.col("_last") - back).drop("_last")
