"""Registered queries for what surrounds the parser: pages and files, records and their maintenance, plans, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import ordered, store
from ..sources import pages, sheets
from ..sources.shared import work_folder
from ..streaming import incremental
from . import ranges, search
from .queries import BOUNDS, LOW, bounds, query, table

# -- pages and files --------------------------------------------------------------------------------


@query("SELECT page_id, strlen(html) >= 2000 AND contains(html[1:900], '</nav>') AS whole, strlen(html) AS bytes FROM pages")
def file_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a file's bytes, and a mark among its first characters."""
    rows = table(spark, sf_dir, "pages").withColumn("bytes", F.octet_length("html").cast("bigint"))
    return rows.select("page_id", text.page_is_complete("html", 2000, ("</nav>",), within=900, size="bytes").alias("whole"), "bytes")


@query(r"""SELECT regexp_replace(url, '[\\/*?:"<>|,\s]', '_', 'g') || '-' || CAST(page_id AS VARCHAR) || '.html' AS html_file, strlen(html) AS bytes, md5(html) AS html_md5 FROM pages""")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files under their names, read back."""
    folder = work_folder(spark, "page-files")
    named = table(spark, sf_dir, "pages").select(F.concat("url", F.lit("-"), F.col("page_id").cast("string")).alias("case_number"), "html")
    pages.write_files(named, folder)
    return pages.read_files(spark, folder).select("html_file", "bytes", F.md5("html").alias("html_md5"))


@query("SELECT p_partkey, '/a?b=' || CAST(p_partkey AS VARCHAR) AS href, p_name AS label, CAST(0 AS BIGINT) AS pos FROM part UNION ALL SELECT p_partkey, '/c', 'two', CAST(1 AS BIGINT) FROM part")
def anchor_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in capitals or not, their addresses in double quotes, single ones or none."""
    k, to = F.col("p_partkey") % 3, F.concat(F.lit("/a?b="), F.col("p_partkey").cast("string"))
    link = F.when(k == 0, F.concat(F.lit('<A class=x HREF="'), to, F.lit('">'))).when(k == 1, F.concat(F.lit("<a href = '"), to, F.lit("' id=y>"))).otherwise(F.concat(F.lit("<a\nid=z Href="), to, F.lit(" title=t>")))
    html = F.concat(F.lit("<p>no <abbr href='x'>link</abbr>"), link, F.lit("<b>"), "p_name", F.when(k == 0, "</b></A>").otherwise("</b></a>"), F.lit("<a href=/c>two</a>"))
    got = pages.anchors(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")
    return got.withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page_no FROM orders")
def next_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as a chain of result pages, linked in the four ways that a next link has."""
    at = ordered.Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(at).cast("string").alias("next"))
    way = F.col("o_orderkey") % 4
    href = F.concat(F.lit("href='/list?p="), "next", F.lit("'"))
    link = (
        F.when(way == 0, F.concat(F.lit("<a title='下一頁' "), href, F.lit(">→</a>"))).when(way == 1, F.concat(F.lit("<a "), href, F.lit(" class='x page-next'>→</a>")))
        .when(way == 2, F.concat(F.lit("<li class='nextpage-li'><a "), href, F.lit(">→</a></li>"))).otherwise(F.concat(F.lit("<a "), href, F.lit("> 下一頁 </a>")))
    )
    html = F.concat(F.lit("<a href='/list?p=0'>上一頁</a>"), F.coalesce(link, F.lit("<span>下一頁</span>")))
    got = pages.numbered(rows.select("o_custkey", F.concat(F.lit("/list?p="), F.col("o_orderkey").cast("string")).alias("url"), html.alias("html")), "o_custkey", "url", "html")
    return got.select("o_custkey", F.substring_index("url", "=", -1).cast("bigint").alias("o_orderkey"), "page_no")


@query("SELECT 'A' AS strategy, o_orderkey FROM orders WHERE o_custkey % 9 = 0 OR year(o_orderdate) BETWEEN 1996 AND 1998 UNION ALL SELECT 'B', o_orderkey FROM orders WHERE o_custkey % 9 <> 0 AND year(o_orderdate) BETWEEN 1996 AND 1998")
def listing_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lists by court, filtered after reading; or the lists of the years alone, which an item without a year is not in."""
    items = table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_custkey") % 9 != 0, F.year("o_orderdate")))
    both = [(name, f(items, "y", 1996, 1998)) for name, f in (("A", pages.by_courts), ("B", pages.by_years))]
    a, b = (df.select(F.lit(name).alias("strategy"), "o_orderkey") for name, df in both)
    return a.unionByName(b)


# -- records ----------------------------------------------------------------------------------------

_COLUMNS = ", ".join(
    f"('{t}', {i}, '{c}', '{k}')"
    for t, cols in (("crawl_records", fixed.CRAWL_RECORDS), ("judgments", [("id", "bigint"), ("crawl_id", "bigint"), *[(c, "string") for c in fixed.JUDGMENT_FIELDS], ("parsed_at", "timestamp")]))
    for i, (c, k) in enumerate(cols)
)


@query(f"SELECT * FROM (VALUES {_COLUMNS}) AS t(name, pos, column_name, kind)")
def table_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables made twice, where there was none, and read."""
    out = []
    for name, schema in (("crawl_records", store.CRAWL_RECORDS), ("judgments", store.JUDGMENTS)):
        path = work_folder(spark, name)
        store.create_if_absent(spark, path, schema)
        got = store.create_if_absent(spark, path, schema)
        out += [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(got.schema)]
    return spark.createDataFrame(out, "name string, pos int, column_name string, kind string")


_LIKE = "SELECT '{0}' AS keyword, count(*) AS n FROM documents WHERE " + LOW.format("text") + " LIKE '%{1}%'"


@query(" UNION ALL ".join(_LIKE.format(k, k.lower()) for k in ("Th_re", "A%b%c", "LICENSE", "é", "100%")))
def like_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by keyword, in which % and _ are wildcards, ASCII letters in either case and others as they are."""
    docs = table(spark, sf_dir, "documents")
    parts = [store.count_like(docs, k, "text").select(F.lit(k).alias("keyword"), "n") for k in ("Th_re", "A%b%c", "LICENSE", "é", "100%")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT doc_id AS id, source, quality, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS parsed FROM documents LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)".replace("l.doc_id IS NULL", "quality IS NULL"))
def judgments_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their judgments, and the flag that follows from these."""
    records = store.reset(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"))
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("crawl_id"), "quality")
    return store.judgments_of(store.mark_parsed(records, judged), judged).select("id", "source", "quality", "parsed")


@query("SELECT doc_id AS id FROM documents WHERE source || '/' || CAST(doc_id AS VARCHAR) = 'src1/21' OR source || '/' || CAST(doc_id AS VARCHAR) = 'none'")
def record_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("html_file"))
    return store.of_file(records, "src1/21")


@query("SELECT 'current' AS snapshot, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'rebuilt', o_orderkey, o_totalprice FROM orders")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by its next snapshot; then reset and rebuilt from all there is."""
    rows, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), work_folder(spark, "snapshots")
    store.replace(spark, rows.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.lit(0.0)), path)
    new = rows.where("o_orderkey % 3 <> 0")
    old = store.current(spark, path).where("o_orderkey % 3 <> 0")
    store.replace(spark, store.replace_latest(old.withColumn("v", F.lit(1)), new.withColumn("v", F.lit(2)), "o_orderkey", ["v"]).drop("v"), path)
    now = store.current(spark, path)
    store.replace(spark, rows, path)
    return now.select(F.lit("current").alias("snapshot"), "*").unionByName(store.current(spark, path).select(F.lit("rebuilt").alias("snapshot"), "*"))


@query("SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type FROM events UNION ALL SELECT user_id, event_id + 1000000, 'late' FROM events WHERE user_id % 3 = 0 AND event_type = 'click') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def late_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read before comes again in a later version: a further run reads that alone, and it wins."""
    events, at = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), work_folder(spark, "late")
    handle = incremental.upsert_latest(f"{at}/out", "user_id", "event_id")
    events.write.parquet(f"{at}/in")
    incremental.run_available(spark, f"{at}/in", events.schema, f"{at}/checkpoint", handle)
    again = events.where("user_id % 3 = 0 AND event_type = 'click'").select("user_id", (F.col("event_id") + 1_000_000).alias("event_id"), F.lit("late").alias("event_type"))
    again.write.mode("append").parquet(f"{at}/in")
    incremental.run_available(spark, f"{at}/in", events.schema, f"{at}/checkpoint", handle)
    return incremental.latest(spark, f"{at}/out", "user_id", "event_id")


@query("""WITH r AS (SELECT doc_id, doc_id % 5 AS m, n_chars >= 300 AS long FROM documents)
SELECT doc_id AS case_number, CASE WHEN m < 3 AND NOT (m = 0 AND long) AND long THEN 'new-' ELSE 'old-' END || CAST(doc_id AS VARCHAR) AS html_file, CAST(CASE WHEN m < 3 AND NOT (m = 0 AND long) AND long THEN 0 ELSE 1 END AS INTEGER) AS parsed FROM r""")
def recrawled_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of five documents have no new page; of the others' old pages one in three is whole, where the text is long enough."""
    docs = table(spark, sf_dir, "documents").withColumn("m", F.col("doc_id") % 5)
    name = lambda x: F.concat(F.lit(x), F.col("doc_id").cast("string"))
    records = docs.select(F.col("doc_id").alias("case_number"), F.lit("https://example.org/").alias("source_url"), name("old-").alias("html_file"), F.lit(0).alias("crawled_at"), F.lit(1).alias("parsed"))
    files = docs.where("m <> 1").select(name("old-").alias("html_file"), F.when(F.col("m") == 0, F.concat("text", F.lit("</html>"))).otherwise("").alias("html"))
    fetched = docs.where("m < 3").select(F.col("doc_id").alias("case_number"), name("new-").alias("html_file"), F.lit(1).alias("crawled_at"), F.concat("text", F.lit("</html>")).alias("html"))
    return store.recrawl(records, files, text.page_is_complete("html", 307, ("</html>",)), fetched).select("case_number", "html_file", "parsed")


@query("SELECT user_id, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) < 14")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.to_retry(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", 14)


# -- plans ------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN CAST(year(o_orderdate) AS INTEGER) - 1911 END AS a, CASE WHEN o_custkey % 2 = 0 THEN CAST(year(o_orderdate) AS INTEGER) - 1909 END AS b FROM orders)
SELECT o_orderkey, CAST(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 104) END AS INTEGER) AS low, CAST(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(b, 115) END AS INTEGER) AS high FROM o""")
def roc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year ranges of which one bound, the other or none is given; the current year is 2026 here."""
    k, day = F.col("o_custkey"), F.date_format("o_orderdate", "yyyy/MM/dd")
    later = F.date_format(F.add_months("o_orderdate", 24), "yyyy-MM-dd")
    got = text.roc_range(F.when(k % 3 == 0, day), F.when(k % 2 == 0, later).otherwise(""), 2026)
    return table(spark, sf_dir, "orders").select("o_orderkey", got.alias("r")).select("o_orderkey", "r.low", "r.high")


@query("""SELECT event_id, try_cast(CASE event_id % 4 WHEN 2 THEN NULL WHEN 3 THEN '2024-13-01' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS day, 'judgments_' || event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.xlsx' AS output FROM events""")
def days_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as they are typed, with slashes, hyphens or errors, and names from times."""
    k = F.col("event_id") % 4
    typed = F.when(k == 0, F.date_format("ts", "yyyy/MM/dd")).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).when(k == 2, "yesterday").otherwise("2024/13/01")
    return table(spark, sf_dir, "events").select("event_id", text.iso_day(typed).alias("day"), text.output_name("event_type", "ts").alias("output"))


@query(f"""WITH {BOUNDS}, d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE o_custkey % 4 <> 0) AS fresh FROM orders GROUP BY 1),
y AS (SELECT year(e) - y AS ord, greatest(make_date(y, 1, 1), s) AS cs, least(make_date(y, 12, 31), e) AS ce FROM b, unnest(generate_series(year(s), year(e))) AS g(y)),
m AS (SELECT ord, cs, ce, n, fresh, greatest(2000 - coalesce(sum(n) OVER (PARTITION BY ord ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM y LEFT JOIN d ON day BETWEEN cs AND ce),
g AS (SELECT ord, cs, ce, coalesce(sum(least(n, room)), 0) AS fetched, coalesce(sum(least(fresh, room)), 0) AS new FROM m GROUP BY ord, cs, ce),
w AS (SELECT *, coalesce(sum(new) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT CAST(ord AS INTEGER) AS ord, cs AS chunk_start, ce AS chunk_end, CAST(fetched AS BIGINT) AS fetched, CAST(new AS BIGINT) AS new, CAST(before AS BIGINT) AS before, CASE WHEN fetched < 1900 THEN 'ok' WHEN ce - cs + 1 <= 7 THEN 'warn_min_span' ELSE 'warn_same_year' END AS verdict FROM w WHERE before < 5000""")
def batched_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round over the years' chunks: what a call gets, what of it is new, and where the target ends the round."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_custkey") % 4 != 0).alias("fresh"))
    return ranges.batched_plan(ranges.year_chunks(bounds(spark, sf_dir)), days, 5000)


# -- cells ------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, length(t) AS n, right(t, 5) AS tail FROM (SELECT doc_id, CASE WHEN length(t) > {fixed.CELL_CAP} THEN t[1:{fixed.CELL_CAP}] || '{fixed.CUT_MARK}' ELSE t END AS t FROM (SELECT doc_id, CASE lang WHEN 'en' THEN text || repeat('x', 33000) WHEN 'de' THEN NULL ELSE text END AS t FROM documents)) WHERE t IS NOT NULL
UNION ALL SELECT doc_id, 0, '' FROM documents WHERE lang = 'de'""")
def cell_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("lang") == "en", F.concat("text", F.expr("repeat('x', 33000)"))).when(F.col("lang") != "de", F.col("text"))
    got = search.cells(table(spark, sf_dir, "documents").select("doc_id", said.alias("t")), [("doc_id", "doc_id"), ("t", "t")])
    return got.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("t").cast("bigint").alias("n"), F.right("t", F.lit(5)).alias("tail"))


@query('SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS "序號", (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 2 = 0 AS shaded, CAST(o_orderkey AS VARCHAR) AS "裁判字號", coalesce(o_orderstatus, \'\') AS "法院" FROM orders')
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return sheets.sheet_rows(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], month, [("o_orderkey", "裁判字號"), ("o_orderstatus", "法院")])


@query("SELECT count(*) AS exported, count(DISTINCT source) AS courts FROM documents WHERE contains(lower(text), 'tion')".replace("lower(text)", LOW.format("text")))
def export_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = search.search(table(spark, sf_dir, "documents"), "tion", ("text",), order=[F.desc("doc_id")])
    return got.agg(F.count(F.lit(1)).alias("exported"), F.count_distinct("source").alias("courts"))
