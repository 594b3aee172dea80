"""The registered queries of the engine's own operators, each beside the DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import judgments, ordered, store
from ..sources import pages as pages_
from ..sources.shared import staged, work_folder
from ..streaming import incremental
from . import ranges, search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BLANKS = fixed.BLANKS
LINK = r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
LINKS = f"links AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) AS href, regexp_replace(unnest(regexp_extract_all(html, '{LINK}', 2)), '<[^>]*>', '', 'g') AS label, generate_subscripts(regexp_extract_all(html, '{LINK}', 1), 1) - 1 AS pos FROM pages)"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


# -- pages and addresses ----------------------------------------------------------------------------

TITLE = r"regexp_extract(substr(html, 1, 2000), '(?s)<title>\s*(.*?)\s*</title>', 1)"


@query(f"SELECT page_id, {TITLE} AS title, regexp_replace(trim({TITLE}), '{BLANKS}', '', 'g') AS bare_title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = text.page_title("html")
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), text.squeeze(title).alias("bare_title"))


@query("SELECT length(html) >= 1500 AND contains(html, '</html>') AS complete, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def page_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = text.page_is_complete("html", 1500, ("</html>",))
    return table(spark, sf_dir, "pages").groupBy(ok.alias("complete")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars"))


VISIBLE = "html"
for _tag in ("script", "style", "nav", "noscript"):
    VISIBLE = f"regexp_replace({VISIBLE}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
VISIBLE = rf"trim(regexp_replace(regexp_replace({VISIBLE}, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')"


@query(f"SELECT page_id, CAST(length({VISIBLE}) AS BIGINT) AS visible_chars, md5({VISIBLE}) AS visible_md5 FROM pages")
def page_visible_text_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen: Column = F.col("html")
    for tag in ("script", "style", "nav", "noscript"):
        seen = F.regexp_replace(seen, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    seen = F.trim(F.regexp_replace(F.regexp_replace(seen, "<[^>]*>", " "), "[ \t\n\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", seen.alias("v")).select("page_id", F.length("v").cast("bigint").alias("visible_chars"), F.md5("v").alias("visible_md5"))


HOST, LANG, NUMBER, QUERY = "^https?://([^/]+)", "^https?://[^/]+/([a-z][a-z])/", "/([0-9]+)", "[?](.*)"
URL_PARTS = f"regexp_extract(url, '{HOST}', 1) AS host, regexp_extract(url, '{LANG}', 1) AS lang, regexp_extract(url, '{NUMBER}', 1) AS number, regexp_extract(url, '{QUERY}', 1) AS query"


def with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").withColumns({"host": part(HOST), "lang": part(LANG), "number": part(NUMBER), "query": part(QUERY)})


@query(f"SELECT page_id, {URL_PARTS} FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parts(spark, sf_dir).select("page_id", "host", "lang", "number", "query")


@query(f"SELECT page_id, y FROM (SELECT page_id, try_cast(substr(regexp_extract(url, '{NUMBER}', 1), 1, 3) AS INTEGER) AS y FROM pages) WHERE y IS NULL OR y BETWEEN 104 AND 400")
def url_number_year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = with_parts(spark, sf_dir).select("page_id", F.substring("number", 1, 3).try_cast("int").alias("y"))
    return year.where(text.in_years("y", 104, 400))


@query(r"""SELECT page_id, regexp_replace(url, '[\\/*?:"<>|,\s]', '_', 'g') AS file_name FROM pages""")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.file_name("url").alias("file_name"))


@query(f"SELECT page_id, contains(html, host) AND contains(html, number) AND contains({TITLE}, 'e') AS matches FROM (SELECT *, {URL_PARTS} FROM pages)")
def title_matches_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return with_parts(spark, sf_dir).select("page_id", (html.contains(F.col("host")) & html.contains(F.col("number")) & text.page_title("html").contains("e")).alias("matches"))


ADDRESS = "'https://example.org/data?ty=JD&id=TPHV%2c' || CAST(year(o_orderdate) - 1911 AS VARCHAR) || '%2c+%e4%b8%8a%2c' || CAST(o_orderkey AS VARCHAR) || '%2c1&ot=in'"


@query("SELECT o_orderkey, CAST(year(o_orderdate) - 1911 AS VARCHAR) AS case_year, '上' AS case_type, CAST(o_orderkey AS VARCHAR) AS case_no, CAST(year(o_orderdate) - 1911 AS INTEGER) AS roc FROM orders WHERE year(o_orderdate) - 1911 BETWEEN 85 AND 88")
def case_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr(ADDRESS.replace("VARCHAR", "STRING"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"))
    got = rows.select("o_orderkey", text.url_key("url").alias("k"), text.url_year("url").alias("roc")).where(text.in_years("roc", 85, 88))
    return got.select("o_orderkey", F.col("k.year").alias("case_year"), F.col("k.type").alias("case_type"), F.col("k.number").alias("case_no"), "roc")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'stale' WHEN o_custkey % 7 = 0 THEN 'mismatch' WHEN o_custkey % 3 = 0 OR o_custkey % 2 = 0 THEN 'stub' END AS reason FROM orders""")
def page_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of orders: some landed elsewhere, have another title, lack the mark, or are short."""
    when = lambda n, a, b: F.when(F.col("o_custkey") % n == 0, a).otherwise(b)
    number = F.col("o_orderkey").cast("string")
    url = F.expr(ADDRESS.replace("VARCHAR", "STRING"))
    title = F.concat((F.year("o_orderdate") - 1911).cast("string"), F.lit(" 年度上字第 "), when(7, F.lit("-"), number), F.lit(" 號"))
    html = F.concat(F.lit("<title> "), title, F.lit("</title>"), when(3, F.lit(""), F.lit("htmlcontent")), when(2, F.lit("x"), F.repeat(F.lit("x"), 5000)))
    landed = when(5, F.lit("https://example.org/data?id=other"), url)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.reject_reason(html, url, landed).alias("reason"))


@query(f"WITH {LINKS} SELECT page_id, CAST(pos AS BIGINT) AS pos, href, label FROM links")
def nav_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_.anchors(table(spark, sf_dir, "pages"), "page_id", "html").withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH {LINKS} SELECT page_id, href, CAST(pos AS BIGINT) AS pos, label FROM links QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1")
def nav_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_wins(nav_link_rows(spark, sf_dir), ["page_id", "href"], ["pos"])


@query(f"WITH {LINKS} SELECT page_id, substr(label, 1, 1) AS name, label AS value FROM links QUALIFY row_number() OVER (PARTITION BY page_id, substr(label, 1, 1) ORDER BY pos DESC) = 1")
def metadata_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nav_link_rows(spark, sf_dir).select("page_id", F.substring("label", 1, 1).alias("name"), F.col("label").alias("value"), "pos")
    return ordered.last_wins(pairs, ["page_id", "name"], ["pos"]).drop("pos")


@query(f"WITH {LINKS} SELECT page_id, coalesce(min_by(href, pos) FILTER (WHERE NOT contains(href, 'e')), min_by(href, pos)) AS href FROM (SELECT page_id, pos, href FROM links) GROUP BY page_id")
def results_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nav_link_rows(spark, sf_dir).withColumn("href", F.regexp_replace("href", "e", "gy="))
    return pages_.results_link(got, "page_id").withColumn("href", F.regexp_replace("href", "gy=", "e"))


@query("SELECT c_nationkey, c_custkey, '臺灣新竹地方法院 113 年度訴字第 ' || CAST(c_custkey AS VARCHAR) || ' 號' AS case_number, '臺灣新竹地方法院' AS court, c_mktsegment AS judgment_date, c_name AS case_title, '/d?id=' || CAST(c_custkey AS VARCHAR) AS url FROM customer")
def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<tr class='r'><td>1</td><td><b><a class=x href=\"/d?id="), F.col("c_custkey").cast("string"), F.lit('">臺灣新竹地方法院　113 年度訴字第 '), F.col("c_custkey").cast("string"), F.lit(" 號</a></b></td><td> "), "c_mktsegment", F.lit("</td><td>"), "c_name", F.lit("</td></tr>"))
    # a listing page holds some rows of one nation: 50, as a result page does
    listing = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 50).alias("page_no")).agg(F.array_join(F.collect_list(row), "\n").alias("html"))
    pages = listing.withColumn("page", F.struct("c_nationkey", "page_no"))
    got = pages_.listing_rows(pages, "page", "html")
    return got.select(F.col("page.c_nationkey").alias("c_nationkey"), F.regexp_extract("url", "id=(.*)", 1).cast("bigint").alias("c_custkey"), "case_number", "court", "judgment_date", "case_title", "url")


@query("SELECT p_partkey, upper(p_brand) AS code, p_brand AS label FROM part")
def court_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.concat(F.lit("/list?gy=jcourt&gc="), F.upper("p_brand"))
    links = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(F.struct(F.lit("/list").alias("href"), F.lit("all").alias("label")), F.struct(href.alias("href"), F.concat(F.lit(" "), "p_brand", F.lit("\n(12)")).alias("label")), F.struct(href.alias("href"), F.lit("again").alias("label")))).alias("pos", "l"))
    return pages_.court_links(links.select("p_partkey", "pos", "l.*"), "p_partkey").select("p_partkey", "code", "label")


# -- distributions and search -----------------------------------------------------------------------


@query(f"SELECT coalesce(nullif(regexp_extract(url, '{HOST}', 1), ''), '{fixed.UNKNOWN}') AS value, count(*) AS n, min(page_id) AS first_at FROM pages GROUP BY 1")
def host_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.distribution(with_parts(spark, sf_dir), "host", "page_id", fixed.UNKNOWN)


@query(f"SELECT coalesce(nullif(lang, ''), '{fixed.UNKNOWN}') AS value, count(*) AS n, min(doc_id) AS first_at FROM documents GROUP BY 1")
def lang_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.distribution(table(spark, sf_dir, "documents"), "lang", "doc_id", fixed.UNKNOWN)


@query("SELECT 'lang' AS attribute, lang AS value, count(*) AS n, min(doc_id) AS first_at FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), min(doc_id) FROM documents GROUP BY source")
def two_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.distributions(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", fixed.UNKNOWN)


@query(f"""SELECT doc_id, lang, source, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)
WHERE (contains({LOW.format("text")}, 'tion') OR contains({LOW.format("source")}, 'tion')) AND contains({LOW.format("lang")}, 'e') AND source >= 'src1' AND source <= 'src7'
ORDER BY n_chars DESC, doc_id DESC LIMIT 50 OFFSET 10""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    got = search.search(both, "TION", ("text", "source"), "E", "lang", "src1", "src7", "source", order=[F.desc("n_chars"), F.desc("doc_id")], limit=50, offset=10)
    return got.select("doc_id", "lang", "source", "n_chars", "quality")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS \"裁判字號\", coalesce(o_orderstatus, '') AS \"法院\", coalesce(o_orderpriority, '') AS \"案件類型\", CAST(o_custkey AS VARCHAR) AS \"原告／聲請人\" FROM orders")
def orders_export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cells(table(spark, sf_dir, "orders"), [("o_orderkey", "裁判字號"), ("o_orderstatus", "法院"), ("o_orderpriority", "案件類型"), ("o_custkey", "原告／聲請人")])


# -- text -------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '{fixed.CUT_MARK}' ELSE text END AS capped FROM documents")
def text_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.cap("text", 300).alias("capped"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN quality = 0 THEN '' WHEN toxic = 1 THEN lang END, ''), nullif(source, ''), '') AS chosen FROM documents LEFT JOIN labels USING (doc_id)")
def first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    hint = F.when(F.col("quality") == 0, "").when(F.col("toxic") == 1, F.col("lang"))
    return both.select("doc_id", text.first_nonempty(hint, "source").alias("chosen"))


@query("SELECT doc_id, CASE WHEN contains(kind, '判決') THEN '判決' WHEN contains(kind, '裁定') THEN '裁定' WHEN kind <> '' THEN '其他' ELSE '' END AS kind FROM (SELECT doc_id, CASE lang WHEN 'en' THEN '民事判決' WHEN 'de' THEN '刑事裁定' WHEN 'fr' THEN '其' ELSE '' END AS kind FROM documents)")
def doc_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "民事判決").when(F.col("lang") == "de", "刑事裁定").when(F.col("lang") == "fr", "其").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", text.judgment_kind(kind).alias("kind"))


FOOT = "Licensed under|This work is licensed|All rights reserved"


@query(rf"SELECT doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS body_md5 FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '{FOOT}') THEN regexp_replace(string_split_regex(text, '{FOOT}')[1], '^\s+|\s+$', '', 'g') ELSE text END AS t FROM documents)")
def strip_license_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_at("text", FOOT).alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("body_md5"))


CITE = "[A-Z][a-z]+tion"


@query(f"SELECT doc_id, substr(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '；'), 1, 1000) AS cited FROM (SELECT doc_id, regexp_extract_all(text, '{CITE}') AS l FROM documents)")
def cite_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.distinct_joined(F.regexp_extract_all("text", F.lit(CITE), F.lit(0)), "；", 1000).alias("cited"))


# -- order-dependent --------------------------------------------------------------------------------


@query(f"""WITH {LINES}, s AS (SELECT *, sum(CASE WHEN length(line) <= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM lines)
SELECT doc_id, CAST(section AS BIGINT) AS section, max(line) FILTER (WHERE length(line) <= 60) AS title, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE length(line) > 60), '')) AS text_md5 FROM s GROUP BY doc_id, section""")
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ordered.titled_sections(lines(spark, sf_dir), "doc_id", "pos", "line", F.length("line") <= 60)
    return got.select("doc_id", "section", "title", F.md5("text").alias("text_md5"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events")
def speaker_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return ordered.forward_fill(events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase", F.trunc("ts", "month")).select("event_id", "user_id", "last_purchase")


@query(f"""WITH {LINES}, s AS (SELECT *, coalesce(sum(CASE WHEN length(line) > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM lines)
SELECT doc_id, CAST(island AS BIGINT) AS island, md5(string_agg(line, '' ORDER BY pos)) AS text_md5 FROM s GROUP BY doc_id, island""")
def fragment_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ordered.islands(lines(spark, sf_dir), "doc_id", "pos", "line", F.length("line") <= 30)
    return got.select("doc_id", "island", F.md5("text").alias("text_md5"))


@query("""WITH r AS (SELECT conv_id, role, min(turn) AS first_at, string_agg(substr(text, 1, 5), '、' ORDER BY turn) AS names FROM conversations GROUP BY conv_id, role)
SELECT conv_id, string_agg(role || '：' || names, '；' ORDER BY first_at) AS roles FROM r GROUP BY conv_id""")
def roles_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.roles_joined(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", F.substring("text", 1, 5))


@query("SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts >= last - INTERVAL 1 DAY")
def last_match_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.last_match_window(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", F.expr("INTERVAL 1 DAY")).select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.budget_prefix(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 500).select("o_orderkey", "o_custkey")


@query("""WITH i AS (SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS y, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) - 1) // 100 AS page FROM orders),
p AS (SELECT o_orderpriority, page, max(CASE WHEN y BETWEEN 1998 AND 1999 THEN 1 ELSE 0 END) AS hit, max(y) AS latest FROM i GROUP BY 1, 2),
s AS (SELECT o_orderpriority, min(page) AS stop FROM p WHERE hit = 0 AND latest < 1998 GROUP BY 1)
SELECT o_orderkey, CAST(page AS BIGINT) AS page FROM i LEFT JOIN s USING (o_orderpriority) WHERE y BETWEEN 1998 AND 1999 AND (stop IS NULL OR page < stop)""")
def early_stop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = -(F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    numbered = ordered.row_index(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), "o_orderkey"], month, "at", ["o_orderpriority"])
    items = numbered.select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"), F.floor(F.col("at") / 100).cast("bigint").alias("page"))
    return ordered.early_stop(items, "o_orderpriority", "page", "y", 1998, 1999).select("o_orderkey", "page")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return ordered.row_index(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], month).select("o_orderkey", "row_index")


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 80 AS BIGINT) AS batch FROM events")
def batch_of_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.batches(table(spark, sf_dir, "events"), ["ts", "event_id"], F.to_date("ts")).select("event_id", "batch")


# -- ranges -----------------------------------------------------------------------------------------

BOUNDS = "b AS (SELECT CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders)"
YEARS = f"{BOUNDS}, y AS (SELECT greatest(make_date(y, 1, 1), s) AS cs, least(make_date(y, 12, 31), e) AS ce, year(e) - y AS ord FROM b, unnest(generate_series(year(s), year(e))) AS g(y))"


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))


@query(f"WITH {YEARS} SELECT CAST(ord AS INTEGER) AS ord, cs AS chunk_start, ce AS chunk_end FROM y")
def year_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.year_chunks(bounds(spark, sf_dir))


@query(f"""WITH RECURSIVE {YEARS}, d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
r(cs, ce, round) AS (SELECT cs, ce, 0 FROM y UNION ALL
SELECT CASE WHEN h = 0 THEN mid + 1 ELSE cs END, CASE WHEN h = 0 THEN ce ELSE mid END, round + 1 FROM (SELECT cs, ce, round, cs + CAST((ce - cs + 1) // 2 - 1 AS INTEGER) AS mid FROM r WHERE ce - cs + 1 > 7 AND (SELECT sum(n) FROM d WHERE day BETWEEN cs AND ce) >= 600), (VALUES (0), (1)) AS v(h))
SELECT cs AS chunk_start, ce AS chunk_end, CAST(f AS BIGINT) AS fetched, CAST(round AS INTEGER) AS round FROM (SELECT *, (SELECT coalesce(sum(n), 0) FROM d WHERE day BETWEEN cs AND ce) AS f FROM r) WHERE NOT (f >= 600 AND ce - cs + 1 > 7)""")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row a day, counted once: every round reads this in place of the orders
    days = staged(table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n")))
    b = bounds(spark, sf_dir).first()
    return ranges.adaptive_split(spark, b["start"], b["end"], lambda c: ranges.count_in(c, days), 600)


@query(f"WITH {YEARS} SELECT cs AS chunk_start, CASE WHEN n < 1900 THEN 'ok' WHEN ce - cs + 1 <= 7 THEN 'warn_min_span' ELSE 'warn_same_year' END AS verdict, n AS fetched FROM (SELECT cs, ce, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN cs AND ce) AS n FROM y)")
def chunk_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    counted = ranges.count_in(ranges.year_chunks(bounds(spark, sf_dir)), days)
    return counted.select("chunk_start", ranges.saturation(F.col("fetched")).alias("verdict"), "fetched")


@query("SELECT y, n, CAST(before AS BIGINT) AS before FROM (SELECT y, n, coalesce(sum(n) OVER (ORDER BY y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1)) WHERE before < 5000")
def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return ranges.within_budget(years, [F.desc("y")], "n", 5000)


@query("SELECT CAST(year(o_orderdate) - 1911 AS INTEGER) AS roc_year, count(*) AS n FROM orders GROUP BY 1")
def roc_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(text.roc_year(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("roc_year")).agg(F.count(F.lit(1)).alias("n"))


# -- records ----------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"))
    return store.insert_ignore(known, table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "role")


@query("SELECT count(*) AS new_rows FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels))")
def count_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_ignore(spark, sf_dir).agg(F.count(F.lit(1)).alias("new_rows"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def replace_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = F.col("event_type") == "purchase"
    target = ordered.last_wins(events.where(bought), ["user_id"], ["ts", "event_id"])
    return store.replace_latest(target, events.where(~bought), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey AS case_number, CASE WHEN o IS NOT NULL THEN 'order-' || CAST(o AS VARCHAR) ELSE c_name END AS html_file, CAST(CASE WHEN o IS NOT NULL THEN 0 ELSE 1 END AS INTEGER) AS parsed FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def mark_recrawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_number"), F.col("c_name").alias("html_file"), F.lit(0).alias("crawled_at"), F.lit(1).alias("parsed"))
    fetched = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_number")).agg(F.concat(F.lit("order-"), F.max("o_orderkey").cast("string")).alias("html_file"), F.lit(1).alias("crawled_at"))
    return store.mark_recrawled(records, fetched).drop("crawled_at")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.unprocessed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'insert' WHEN quality = 1 THEN 'skip' ELSE 'recrawl' END AS action FROM documents LEFT JOIN labels USING (doc_id)")
def action_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.route(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1).select("doc_id", "action")


@query("SELECT doc_id, url AS source_url, CASE WHEN page_id IS NULL THEN 'missing' ELSE 'incomplete' END AS reason FROM (SELECT doc_id, source AS url FROM documents WHERE source <> '') LEFT JOIN pages p ON page_id = doc_id WHERE page_id IS NULL OR NOT (length(html) >= 1500 AND contains(html, '</html>'))".replace("url AS source_url", "d.url AS source_url").replace("source <> '')", "source <> '') d"))
def stub_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_url"), F.col("doc_id").alias("html_file"))
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("html_file"), "html")
    return store.stubs(records, files, text.page_is_complete("html", 1500, ("</html>",))).select("doc_id", "source_url", "reason")


@query("SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name, 'yes' AS nation FROM nation UNION ALL SELECT CAST(r_regionkey AS INTEGER), r_name, '' FROM region")
def schema_evolve_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("yes").alias("nation"))
    b = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return a.unionByName(store.evolve(b, a.columns))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    at = work_folder(spark, "stream")
    events.write.parquet(f"{at}/in")
    incremental.run_available(spark, f"{at}/in", events.schema, f"{at}/checkpoint", incremental.upsert_latest(f"{at}/out", "user_id", "event_id"))
    return incremental.latest(spark, f"{at}/out", "user_id", "event_id")


# -- judgments --------------------------------------------------------------------------------------


def judgment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page in the judgments' layout: its first line is the main text, the rest the reasons."""
    said = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    each = F.transform(F.split(said, "\n"), lambda x: F.concat(F.lit("<div id='l'>"), x, F.lit("</div>")))
    number = F.concat(F.lit("臺灣臺北地方法院 113 年度訴字第 "), F.col("doc_id").cast("string"), F.lit(" 號民事判決"))
    html = F.concat(
        F.lit("<html><head><title>x</title></head><body><div id='jud' class='int-table'><div class='col-th'>裁判字號：</div><div class='col-td'>"), number,
        F.lit("</div><div class='col-th'>裁判日期：</div><div class='col-td'>民國 113 年 5 月 1 日</div><div class='col-th'>裁判案由：</div><div class='col-td'>"), F.col("source"),
        F.lit("</div><div class='jud_content'><div class='htmlcontent'><div class='he-h1 notEdit'>臺灣臺北地方法院民事判決</div><div>原　告　王大明</div><div>訴訟代理人　陳志明律師</div><div>被　告　李小華　住臺北市</div><div>上列當事人間請求返還事件，本院判決如下：</div><div class='notEdit'>主　文</div>"),
        F.element_at(each, 1), F.lit("<div class='notEdit'>理　由</div>"), F.array_join(F.slice(each, F.lit(2), F.greatest(F.size(each), F.lit(1))), ""),
        F.lit("<div>據上論結，依民法第 148 條、民事訴訟法第 78 條，判決如主文。</div><div>中　華　民　國　113　年　5　月　1　日</div><div>民事第一庭　法　官　張文山</div><div>書記官　林美玉</div></div></div></div></body></html>"),
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("crawl_id"), html.alias("html"), F.lit("借名").alias("keyword"))


_FLAT = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[　  \t]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '')"


@query(f"""SELECT doc_id AS crawl_id, '臺灣臺北地方法院 113 年度訴字第 ' || CAST(doc_id AS VARCHAR) || ' 號民事判決' AS case_number, '臺灣臺北地方法院' AS court, '民國 113 年 5 月 1 日' AS judgment_date, source AS case_type, '判決' AS judgment_type,
'王大明' AS plaintiff, '陳志明' AS plaintiff_agent, '李小華' AS defendant, '原告：王大明；被告：李小華' AS party_roles, '張文山' AS judges, '林美玉' AS clerk, '民法第 148 條；民事訴訟法第 78 條' AS applicable_laws,
md5(v[1:10000] || CASE WHEN length(v) > 10000 THEN '{fixed.CUT_MARK}' ELSE '' END) AS verdict_md5, md5(r[1:50000] || CASE WHEN length(r) > 50000 THEN '{fixed.CUT_MARK}' ELSE '' END) AS reasons_md5
FROM (SELECT *, trim(regexp_replace(string_split(text, chr(10))[1], '[　  \t]+', ' ', 'g')) AS v, array_to_string(list_concat({_FLAT.replace("string_split(text, chr(10))", "string_split(text, chr(10))[2:]")}, ['據上論結，依民法第 148 條、民事訴訟法第 78 條，判決如主文。']), chr(10)) AS r FROM documents)""")
def judgment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judgments.parse(judgment_pages(spark, sf_dir))
    shown = ["case_number", "court", "judgment_date", "case_type", "judgment_type", "plaintiff", "plaintiff_agent", "defendant", "party_roles", "judges", "clerk", "applicable_laws"]
    return got.select("crawl_id", *shown, F.md5("verdict").alias("verdict_md5"), F.md5("reasons").alias("reasons_md5"))


# the parser's rules, and what else is maintained and planned
from . import parser_queries, record_queries  # noqa: E402, F401
