"""python -m folioforge run | plan | parse | export | stubs

run     plan, parse and export in one go: the plan is printed, captured pages are parsed and what is found is exported
plan    yearly chunks of a range, newest first
parse   captured .html files of a folder into a table of judgments (only new ones, or all with --reparse)
export  search the table and write a workbook (.xlsx) or CSV parts (any other name)
stubs   records whose page is missing or incomplete"""

from __future__ import annotations

import argparse
import logging
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import judgments, store
from .plans import ranges, search
from .sources import pages, sheets
from .sources.shared import staged

log = logging.getLogger("folioforge")


def day(x: str) -> date:
    return date.fromisoformat(x.replace("/", "-"))


def window(args: argparse.Namespace) -> tuple[date, date]:
    start = day(args.start_date) if args.start_date else date(args.start_year, 1, 1)
    end = day(args.end_date) if args.end_date else date(args.end_year, 12, 31) if args.end_year else date.today()
    if start > end:
        raise SystemExit(f"{start} is after {end}")
    return start, end


def parse(spark: SparkSession, folder: str, table: str, keyword: str = "", reparse: bool = False, file: str | None = None) -> int:
    """Parse new pages (all, with ``reparse``; one, with ``file``) and make the next snapshot current; the number of pages
    parsed.  What could not be read or parsed is appended to ``table``/_rejects with the reason, and tried again."""
    found = pages.captured(spark, file or folder).withColumn("crawl_id", F.xxhash64("html_file")).withColumn("case_number_hint", F.regexp_extract("html_file", r"([^/]+)\.html$", 1))
    old = None if reparse or not store.exists(spark, table) else store.current(spark, table)
    new = found if old is None or file else found.join(old.select("crawl_id", "parsed_at"), "crawl_id", "left").where("parsed_at IS NULL OR modified > parsed_at").drop("parsed_at")
    got = staged(judgments.parse(new.where("html IS NOT NULL").withColumn("keyword", F.lit(keyword))).withColumn("parsed_at", F.current_timestamp()))
    good, bad = got.where("error IS NULL").drop("error"), rejects(new, got)
    store.replace(spark, good if old is None else store.replace_latest(old, good, "crawl_id", ["parsed_at"]), table)
    bad.write.mode("append").parquet(f"{table}/_rejects")
    n, total = good.count(), got.count() + new.where("html IS NULL").count()
    log.info("parsed %d of %d pages of %s", n, total, file or folder)
    return n


def rejects(new: DataFrame, got: DataFrame) -> DataFrame:
    """crawl_id, html_file, reason, rejected_at: files that are not UTF-8, and pages that could not be parsed."""
    failed = got.where("error IS NOT NULL").select("crawl_id", F.col("error").alias("reason")).join(new.select("crawl_id", "html_file"), "crawl_id")
    odd = new.where("html IS NULL").select("crawl_id", F.lit("not UTF-8").alias("reason"), "html_file")
    return failed.unionByName(odd).select("crawl_id", "html_file", "reason", F.current_timestamp().alias("rejected_at"))


def export(spark: SparkSession, table: str, output: str, full_text: bool = False, **wanted) -> bool:
    rows = search.search(store.current(spark, table), **wanted)
    if output.endswith(".xlsx"):
        return sheets.write_workbook(rows, output, full_text)
    sheets.write_csv(rows, output, full_text)
    return True


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="folioforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="what", required=True)
    ap.add_argument("--log", help="also log to this file")
    p = sub.add_parser("run")
    p.add_argument("keyword")
    p.add_argument("folder")
    p.add_argument("table")
    p.add_argument("--start-year", type=int, default=2015)
    p.add_argument("--end-year", type=int)
    p.add_argument("--start-date", default="")
    p.add_argument("--end-date", default="")
    p.add_argument("-o", "--output", default="")
    p.add_argument("--full-text", action="store_true")
    p = sub.add_parser("plan")
    p.add_argument("--start-year", type=int, default=2015)
    p.add_argument("--end-year", type=int)
    p.add_argument("--start-date", default="")
    p.add_argument("--end-date", default="")
    p = sub.add_parser("parse")
    p.add_argument("folder")
    p.add_argument("table")
    p.add_argument("--keyword", default="")
    p.add_argument("--reparse", action="store_true")
    p.add_argument("--file", help="one page, whether it was parsed before or not")
    p = sub.add_parser("export")
    p.add_argument("table")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-n", "--num", type=int, default=100, help="0: all")
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("-k", "--keyword")
    p.add_argument("-c", "--court")
    p.add_argument("--start-date")
    p.add_argument("--end-date")
    p.add_argument("--typed-dates", action="store_true")
    p.add_argument("--full-text", action="store_true")
    p = sub.add_parser("stubs")
    p.add_argument("records")
    p.add_argument("folder")
    args = ap.parse_args(argv)
    form = "%(asctime)s %(levelname)s %(message)s"
    logging.basicConfig(level=logging.INFO, format=form, handlers=[logging.StreamHandler(), *([logging.FileHandler(args.log, encoding="utf-8")] if args.log else [])])
    spark = SparkSession.builder.appName("folioforge").getOrCreate()
    if args.what in ("plan", "run"):
        ranges.year_chunks(spark.createDataFrame([window(args)], "start date, end date")).orderBy("ord").show(1000)
    if args.what == "run":
        print(parse(spark, args.folder, args.table, args.keyword))
        output = args.output or f"judgments_{args.keyword}_{datetime.now():%Y%m%d_%H%M%S}.xlsx"
        done = export(spark, args.table, output, args.full_text, keyword=args.keyword)
        log.info("exported to %s" if done else "nothing to export to %s", output)
        return 0 if done else 1
    if args.what == "plan":
        return 0
    if args.what == "parse":
        print(parse(spark, args.folder, args.table, args.keyword, args.reparse, args.file))
    elif args.what == "stubs":
        store.stubs(spark.read.parquet(args.records), pages.captured(spark, args.folder), text.page_is_complete("html", within=20_000, size="bytes")).select("case_number", "source_url", "reason").show(1000, False)
    else:
        done = export(spark, args.table, args.output, args.full_text, keyword=args.keyword, court=args.court, start=args.start_date, end=args.end_date, typed=args.typed_dates, limit=args.num or None, offset=args.offset)
        return 0 if done else 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
