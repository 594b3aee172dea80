"""Captured pages and listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators.ordered import first_wins
from .shared import staged


#: What ends a page's file beside the page itself.
PAGE_END = "\n<!-- end of page -->\n"


def captured(spark: SparkSession, folder: str) -> DataFrame:
    """html_file, html, bytes, modified of every .html file in a folder; one row a file, html null where it is not UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    return files.select(F.col("path").alias("html_file"), F.try_validate_utf8(F.col("content").cast("string")).alias("html"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def write_files(pages: DataFrame, folder: str, name: str = "case_number", html: str = "html") -> None:
    """Each page as a text file under its sanitised name: ``folder``/file=NAME.html/part-..., written by Spark's committer."""
    named = pages.select(F.concat(text.file_name(name), F.lit(".html")).alias("file"), F.col(html).alias("value"))
    named.write.mode("append").partitionBy("file").option("lineSep", PAGE_END).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """html_file, html, bytes of what :func:`write_files` wrote."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    html = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), PAGE_END + r"\z", "")
    name = F.try_url_decode(F.replace(F.regexp_extract("path", r"/file=([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B")))
    return files.select(name.alias("html_file"), html.alias("html"), F.length(F.encode(html, "UTF-8")).cast("bigint").alias("bytes"))


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, href, label of every link of a page, in page order; names in either case, values quoted or not."""
    regex = r"""(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(regex), F.lit(1)).alias("href"), F.regexp_extract_all(F.col(html), F.lit(regex), F.lit(2)).alias("label"))
    rows = pages.select(F.col(key), F.posexplode(pairs).alias("pos", "a"))
    return rows.select(key, "pos", F.regexp_replace("a.href", """^["']|["']$""", "").alias("href"), F.regexp_replace("a.label", "<[^>]*>", "").alias("label"))


def next_link(html: Column | str) -> Column:
    """The address of the next result page, null on the last: a link with the title, of the class, within an element of
    such a class, or with the text, in this order."""
    x = text.col(html)
    href = r"""href\s*=\s*["']([^"']*)["']"""
    first = lambda tag: F.nullif(F.regexp_extract(F.regexp_extract(x, tag, 0), "(?i)" + href, 1), F.lit(""))
    return F.coalesce(
        first(rf"""(?is)<a\s[^>]*title\s*=\s*["']{fixed.NEXT_PAGE}["'][^>]*>"""),
        first(rf"""(?is)<a\s[^>]*class\s*=\s*["'](?:[^"']*\s)?{fixed.NEXT_CLASS}(?:\s[^"']*)?["'][^>]*>"""),
        F.nullif(F.regexp_extract(x, rf"""(?is)<[a-z]+\s[^>]*class\s*=\s*["'][^"']*{fixed.NEXT_PART}[^"']*["'][^>]*>\s*<a\s[^>]*?{href}""", 1), F.lit("")),
        F.nullif(F.regexp_extract(x, rf"""(?is)<a\s[^>]*?{href}[^>]*>\s*{fixed.NEXT_PAGE}\s*</a>""", 1), F.lit("")),
    )


def numbered(pages: DataFrame, group: str, url: str, html: str) -> DataFrame:
    """group, url, page_no (from 0) of captured result pages that can be reached by next links from a group's first one.

    Pointers are doubled: a round joins each page with the one as far ahead as was reached before, so the rounds grow
    with the logarithm of the longest list.  Pages on a ring of links have no first one and are left out."""
    link = pages.select(F.col(group).alias("g"), F.col(url).alias("u"), next_link(html).alias("n"))
    first = link.join(link.where("n is not null").select("g", F.col("n").alias("u")).distinct(), ["g", "u"], "left_anti").select("g", "u").withColumn("page_no", F.lit(0).cast("bigint"))
    done, ahead, far = first, link.where("n is not null").join(link.select("g", F.col("u").alias("n")), ["g", "n"], "left_semi").select("g", "u", "n"), 1
    while not (more := done.join(ahead, ["g", "u"]).select("g", F.col("n").alias("u"), (F.col("page_no") + far).alias("page_no"))).isEmpty():
        done = staged(done.unionByName(more))
        step = ahead.select("g", F.col("u").alias("n"), F.col("n").alias("m"))
        ahead, far = staged(ahead.join(step, ["g", "n"]).select("g", "u", F.col("m").alias("n"))), far * 2
    return done.select(F.col("g").alias(group), F.col("u").alias(url), "page_no")


def by_courts(listings: DataFrame, year: str, low: int | None, high: int | None) -> DataFrame:
    """Strategy A: every court's whole list, filtered by year after reading; items without a year stay."""
    return listings if low is None else listings.where(text.in_years(year, low, high))


def by_years(listings: DataFrame, year: str, low: int | None, high: int | None) -> DataFrame:
    """Strategy B: only the lists of the years asked for are read (a partition filter on stored listings)."""
    return listings if low is None else listings.where(F.col(year).isin(list(range(high, low - 1, -1))))


def court_links(links: DataFrame, key: str) -> DataFrame:
    """The links that narrow results to a court, first of each court code, labelled by their first line or the code."""
    code = F.regexp_extract("href", "gy=jcourt&(?:amp;)?gc=([^&]+)", 1)
    rows = links.withColumn("code", code).where("code <> ''")
    label = text.first_nonempty(text.strip(F.get(F.split(text.strip("label"), "\n"), F.lit(0))), "code")
    return first_wins(rows, [key, "code"], ["pos"]).withColumn("label", label)


def results_link(links: DataFrame, key: str) -> DataFrame:
    """key, href: the first link to results that does not narrow them, else the first link."""
    plain = F.min_by("href", F.when(~F.col("href").contains("gy="), F.col("pos")))
    return links.where("href <> ''").groupBy(key).agg(F.coalesce(plain, F.min_by("href", "pos")).alias("href"))


def listing_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, case_number, court, judgment_date, case_title, url of each table row with a link; first of each address.

    Cells are index, case number with its link, date, title; a missing one is empty."""
    rows = pages.select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "row"))
    cell = F.regexp_extract_all("row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
    plain: Column = F.transform(cell, lambda c: text.collapse(F.regexp_replace(c, "<[^>]*>", "")))
    at = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    got = rows.withColumn("cells", plain).withColumn("url", F.regexp_extract("row", r'<a\s[^>]*?href="([^"]+)"', 1)).where("url <> ''")
    got = got.select(key, "pos", at(1).alias("case_number"), text.court_of(at(1)).alias("court"), at(2).alias("judgment_date"), at(3).alias("case_title"), "url")
    return first_wins(got, [key, "url"], ["pos"])
