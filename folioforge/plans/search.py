"""The composable search over parsed records, its export projection and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators.ordered import distributions


def search(df: DataFrame, keyword: str | None = None, keyword_in: tuple[str, ...] = ("keyword", "case_number", "verdict"), court: str | None = None, court_in: str = "court", start: str | None = None, end: str | None = None, day: str = "judgment_date", typed: bool = False, order: list[Column] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Optional predicates, newest first, limit and offset; without a limit the offset is not used.

    Texts match as ASCII-case-insensitive substrings.  Days compare as strings; typed: as dates."""
    if keyword:
        df = df.where(text.contains_any(keyword, *keyword_in, fold=True))
    if court:
        df = df.where(text.contains_any(court, court_in, fold=True))
    value = F.try_to_date(F.replace(F.col(day), F.lit("/"), F.lit("-"))) if typed else F.col(day)
    bound = lambda x: F.lit(x.replace("/", "-")).cast("date") if typed else F.lit(x)
    if start:
        df = df.where(value >= bound(start))
    if end:
        df = df.where(value <= bound(end))
    df = df.orderBy(*(order or [F.desc("parsed_at"), F.desc("crawl_id")]))
    return df.offset(offset).limit(limit) if limit else df


def cells(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """The columns under their labels as capped strings, null as empty."""
    return df.select(*[text.cap(F.coalesce(F.col(c).cast("string"), F.lit("")), fixed.CELL_CAP).alias(label) for c, label in columns])


def export_columns(full_text: bool = False) -> list[tuple[str, str]]:
    return [*fixed.EXPORT, fixed.FULL_TEXT] if full_text else list(fixed.EXPORT)


def summary(df: DataFrame, order: str) -> DataFrame:
    """Counts by court and by case type in one pass."""
    return distributions(df, ["court", "case_type"], order, fixed.UNKNOWN).orderBy("attribute", F.desc("n"), "first_at")
