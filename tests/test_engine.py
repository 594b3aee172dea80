"""Ordered operators, records, ranges, search, sinks, streaming, the command line."""

import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from folioforge import __main__ as cli
from folioforge.functions import fixed, text
from folioforge.operators import ordered, store
from folioforge.plans import ranges, search
from folioforge.sources import pages, sheets
from folioforge.streaming import incremental

from conftest import rows


def test_row_index_and_batches(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ordered.row_index(df, ["k"], F.floor(F.col("k") / 90)).collect()
    assert all(r["row_index"] == r["k"] for r in got) and len(got) == 1000
    got = ordered.batches(df, ["k"], F.floor(F.col("k") / 90), 80).collect()
    assert all(r["batch"] == r["k"] // 80 for r in got)


def test_row_index_by_group_and_null(spark):
    data = [(g, None if i % 7 == 0 else i * 37 % 100, i) for g in ("a", "b", None) for i in range(50)]
    got = ordered.row_index(spark.createDataFrame(data, "g string, k int, i int"), ["k", "i"], F.floor(F.col("k") / 9), by=["g"]).collect()
    assert len(got) == len(data)
    for g in ("a", "b", None):
        want = [r[2] for r in sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
        assert [r["i"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["row_index"])] == want


def test_forward_fill_by_stretches(spark):
    data = [(g, i, i * 31 % 17 if i % 5 == 3 else None) for g in ("a", None) for i in range(60)] + [("c", 1, None)]
    df = spark.createDataFrame(data, "g string, i int, v int")
    whole = ordered.forward_fill(df, "g", ["i"], F.col("v"), "f")
    for stretch in (F.floor(F.col("i") / 4), F.floor(F.col("i") / 25), F.when(F.col("i") > 9, F.col("i"))):
        assert rows(ordered.forward_fill(df, "g", ["i"], F.col("v"), "f", stretch)) == rows(whole)


def test_last_match_window_with_null_keys(spark):
    data = [("a", 1, 0), ("a", 5, 1), ("a", 3, 0), (None, 4, 1), (None, 1, 0), ("b", 9, 0)]
    got = ordered.last_match_window(spark.createDataFrame(data, "k string, t int, m int"), "k", "t", F.col("m") == 1, F.lit(2))
    assert rows(got) == rows(spark.createDataFrame([("a", 5, 1), ("a", 3, 0), (None, 4, 1)], "k string, t int, m int"))


def test_insert_ignore_keeps_first(spark):
    target = spark.createDataFrame([("a", "old")], "k string, keyword string")
    new = spark.createDataFrame([("a", "x", 1), ("b", "y", 3), ("b", "z", 2)], "k string, keyword string, n int")
    got = store.insert_ignore(target, new, "k", ["n"])
    assert rows(got.select("k", "keyword")) == [("b", "z")]
    assert store.insert_ignore(target.unionByName(got.select("k", "keyword")), new, "k", ["n"]).count() == 0


def test_replace_latest_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2)], "k int, v string, at int")
    once = store.replace_latest(old, new, "k", ["at"])
    assert rows(once) == rows(store.replace_latest(once, new, "k", ["at"])) == [(1, "a", 1), (2, "c", 2)]


def test_snapshots(spark, tmp_path):
    t = f"file://{tmp_path}/t"
    store.replace(spark, spark.range(3), t)
    store.replace(spark, store.current(spark, t).where("id > 0"), t)
    assert store.current(spark, t).count() == 2


def test_stubs_and_routes(spark):
    records = spark.createDataFrame([("a", "u", "f1"), ("b", "u", "f2"), ("c", "", "f3"), ("d", "u", "f4")], "case_number string, source_url string, html_file string")
    files = spark.createDataFrame([("f1", "x" * 10), ("f2", "y")], "html_file string, html string")
    assert rows(store.stubs(records, files, F.length("html") >= 5).select("case_number", "reason")) == [("b", "incomplete"), ("d", "missing")]
    items = spark.createDataFrame([("a",), ("z",)], "case_number string")
    assert rows(store.route(items, records, "case_number", F.lit(False)).select("case_number", "action")) == [("a", "recrawl"), ("z", "insert")]


@pytest.mark.parametrize("start, end", [(date(2020, 3, 1), date(2023, 1, 5)), (date(2024, 2, 29), date(2024, 2, 29)), (date(2023, 1, 2), date(2023, 1, 1))])
def test_chunks_cover_once(spark, start, end):
    got = ranges.year_chunks(spark.createDataFrame([(start, end)], "start date, end date")).orderBy("ord").collect()
    days = [d for r in got for d in range(r["chunk_start"].toordinal(), r["chunk_end"].toordinal() + 1)]
    assert sorted(days) == list(range(start.toordinal(), end.toordinal() + 1)) and [r["chunk_end"] for r in got] == sorted((r["chunk_end"] for r in got), reverse=True)


def test_halves_and_split(spark):
    chunk = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 9))], "chunk_start date, chunk_end date")
    assert [(r["chunk_start"], r["chunk_end"]) for r in ranges.halves(chunk).orderBy("half").collect()] == [(date(2024, 1, 5), date(2024, 1, 9)), (date(2024, 1, 1), date(2024, 1, 4))]
    counted = lambda c: c.withColumn("fetched", ranges.days("chunk_start", "chunk_end").cast("bigint") * 10)
    got = ranges.adaptive_split(spark, date(2024, 1, 1), date(2024, 12, 31), counted, 500).collect()
    assert sum(r["fetched"] for r in got) == 3660 and all(r["fetched"] < 500 for r in got)


def test_saturation(spark):
    df = spark.createDataFrame([(date(2023, 1, 1), date(2024, 1, 1), 1900), (date(2023, 1, 1), date(2023, 2, 1), 1900), (date(2023, 1, 1), date(2023, 1, 7), 1900), (date(2023, 1, 1), date(2024, 1, 1), 1899)], "chunk_start date, chunk_end date, n int")
    assert [r[0] for r in df.select(ranges.saturation(F.col("n"))).collect()] == ["split", "warn_same_year", "warn_min_span", "ok"]


def record(i, **more):
    base = {"crawl_id": i, **{f: "" for f in fixed.JUDGMENT_FIELDS}, "parsed_at": datetime(2024, 1, i)}
    return {**base, **more}


@pytest.fixture(scope="module")
def judged(spark):
    schema = "crawl_id long, " + ", ".join(f"{f} string" for f in fixed.JUDGMENT_FIELDS) + ", parsed_at timestamp"
    data = [record(1, court="甲法院", judgment_date="113.05.01", case_number="A<&>", verdict="x" * 40_000, case_type="返還"), record(2, court=None, judgment_date="99.12.31", keyword="Key"), record(3, court="甲法院", judgment_date="2024/01/05", case_type="損害")]
    return spark.createDataFrame([tuple(r.values()) for r in data], schema)


def test_search(judged):
    ids = lambda **a: [r["crawl_id"] for r in search.search(judged, **a).collect()]
    assert ids() == [3, 2, 1] and ids(limit=1, offset=1) == [2] and ids(offset=1) == [3, 2, 1]
    assert ids(keyword="kEY") == [2] and ids(court="甲") == [3, 1]
    assert ids(start="2024/01/01") == [2, 3] or ids(start="2024/01/01") == [3, 2]
    assert ids(start="2024/01/01", typed=True) == [3]


def test_summary(judged):
    got = [(r["attribute"], r["value"], r["n"]) for r in search.summary(judged, "crawl_id").collect()]
    assert got == [("case_type", "返還", 1), ("case_type", fixed.UNKNOWN, 1), ("case_type", "損害", 1), ("court", "甲法院", 2), ("court", fixed.UNKNOWN, 1)]


def test_workbook(judged, tmp_path):
    path = str(tmp_path / "a.xlsx")
    assert sheets.write_workbook(search.search(judged), path, full_text=True)
    with zipfile.ZipFile(path) as z:
        data, stats = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/worksheets/sheet2.xml").decode()
    assert data.count("<row ") == 4 and "A&lt;&amp;&gt;" in data and 'ref="A1:AB4"' in data and 'topLeftCell="C2"' in data
    assert "x" * 32_700 + fixed.CUT_MARK in data and "x" * 32_701 not in data
    assert "甲法院" in stats and fixed.UNKNOWN in stats
    import xml.dom.minidom

    xml.dom.minidom.parseString(data)
    assert not sheets.write_workbook(judged.where("false"), str(tmp_path / "b.xlsx"))


def test_listing_and_links(spark):
    html = '<table><tr><td>1</td><td><a href="/d?id=1">臺灣新竹地方法院 113 年度</a></td><td>113.05.01</td></tr><tr><td>2</td><td><a href="/d?id=1">again</a></td></tr><tr><td>no link</td></tr></table>'
    got = pages.listing_rows(spark.createDataFrame([(1, html), (2, None), (3, "")], "p int, h string"), "p", "h")
    assert rows(got.select("p", "case_number", "court", "judgment_date", "case_title", "url")) == [(1, "臺灣新竹地方法院 113 年度", "臺灣新竹地方法院", "113.05.01", "", "/d?id=1")]


def test_stream_sees_files_once(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    seen = []
    write = incremental.upsert_latest(out, "k", "v")
    handle = lambda df, n: (seen.append(df.count()), write(df, n))
    first = spark.createDataFrame([(1, 1), (2, 1)], "k int, v int")
    first.write.mode("append").parquet(src)
    incremental.run_available(spark, src, first.schema, check, handle)
    spark.createDataFrame([(2, 2), (3, 1)], "k int, v int").write.mode("append").parquet(src)
    incremental.run_available(spark, src, first.schema, check, handle)
    incremental.run_available(spark, src, first.schema, check, handle)
    assert seen == [2, 2]
    assert rows(incremental.latest(spark, out, "k", "v")) == [(1, 1), (2, 2), (3, 1)]
    for _ in range(2):
        incremental.compact(spark, out, "k", "v")
        assert rows(incremental.latest(spark, out, "k", "v")) == [(1, 1), (2, 2), (3, 1)]
    spark.createDataFrame([(3, 5), (4, 1), (2, 1)], "k int, v int").write.mode("append").parquet(src)
    incremental.run_available(spark, src, first.schema, check, handle)
    got = incremental.latest(spark, out, "k", "v")
    assert rows(got) == [(1, 1), (2, 2), (3, 5), (4, 1)]
    incremental.compact(spark, out, "k", "v")
    assert rows(incremental.latest(spark, out, "k", "v")) == rows(got)


def test_command_line(spark, tmp_path):
    folder, table = tmp_path / "html", f"file://{tmp_path}/table"
    folder.mkdir()
    body = "<body><div class='htmlcontent'><div>原告 王大明</div><div class='notEdit'>主　文</div><div>" + "准" * 120 + "</div></div></body>"
    (folder / "A1判決.html").write_text(body, encoding="utf-8")
    assert cli.parse(spark, f"file://{folder}", table, "k") == 1
    (folder / "A2裁定.html").write_text(body, encoding="utf-8")
    (folder / "A3.html").write_bytes(b"<body>\xff\xfe" + body.encode("utf-16-le"))  # not UTF-8: left for another run
    assert cli.parse(spark, f"file://{folder}", table, "k") == 1
    assert sorted(r["judgment_type"] for r in store.current(spark, table).collect()) == ["判決", "裁定"]
    assert cli.export(spark, table, str(tmp_path / "o.xlsx"), keyword="k", limit=1)
    assert cli.export(spark, table, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).option("multiLine", True).csv(f"file://{tmp_path}/csv").count() == 2


def test_like_is_sqls(spark):
    import re

    texts = ["", "abc", "A%C", "a_c xx", "axxbxxc", "ÉCOLE école", "100% sure", "a\nb", "😀x", None, "aab" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for k in ("", "a_c", "a%c", "É", "é", "0%", "_", "%", "a__b", "_x", "b%a%b", "B_A", "[a]", "aab%aab_"):
        want = re.compile(".*".join("".join("." if c == "_" else re.escape(c) for c in p) for p in k.split("%")), re.S)
        low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
        want = re.compile(low(want.pattern), re.S) if k.isascii() else want
        got = {r["t"]: r["g"] for r in df.select("t", text.like_any(k, "t").alias("g")).collect()}
        assert got == {t: t is not None and bool(want.search(low(t))) for t in texts}, k


def test_rejects_are_kept_and_tried_again(spark, tmp_path):
    folder, table = tmp_path / "html", f"file://{tmp_path}/table"
    folder.mkdir()
    (folder / "A1判決.html").write_text("<body><p>x</p></body>", encoding="utf-8")
    (folder / "A2.html").write_bytes(b"<body>\xff\xfe")
    (folder / "A3.html").write_text("<![odd[x]]>", encoding="utf-8")
    assert cli.parse(spark, f"file://{folder}", table) == 1
    assert cli.parse(spark, f"file://{folder}", table) == 0
    got = [(r["html_file"][-7:], r["reason"]) for r in spark.read.parquet(f"{table}/_rejects").collect()]
    assert sorted(got)[::2] == sorted(got)[1::2] and {f for f, _ in got} == {"A2.html", "A3.html"} and ("A2.html", "not UTF-8") in got
    (folder / "A1判決.html").touch()  # fetched again: parsed again, though the table does not grow
    assert cli.parse(spark, f"file://{folder}", table) == 1 and store.current(spark, table).count() == 1
    assert cli.parse(spark, f"file://{folder}", table, file=f"file://{folder}/A1判決.html") == 1


def test_a_table_that_cannot_be_read_is_an_error(spark, tmp_path):
    assert not store.exists(spark, f"file://{tmp_path}/none")
    (tmp_path / "t" / "_current").mkdir(parents=True)
    (tmp_path / "t" / "_current" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        store.exists(spark, f"file://{tmp_path}/t")


def test_run_in_one_go(spark, tmp_path, capsys):
    folder = tmp_path / "html"
    folder.mkdir()
    (folder / "A1判決.html").write_text("<body><div class='htmlcontent'><div>原告 王大明</div><div class='notEdit'>主　文</div><div>" + "准" * 120 + "</div></div></body>", encoding="utf-8")
    assert cli.main(["--log", str(tmp_path / "log"), "run", "k", f"file://{folder}", f"file://{tmp_path}/t", "--start-year", "2020", "--end-year", "2021", "-o", str(tmp_path / "o.xlsx")]) == 0
    assert zipfile.is_zipfile(tmp_path / "o.xlsx") and "2021-01-01" in capsys.readouterr().out
    assert cli.main(["run", "other", f"file://{folder}", f"file://{tmp_path}/t", "-o", str(tmp_path / "p.xlsx")]) == 1  # nothing new, nothing of that keyword


def test_rings_of_pages_and_missing_ones(spark):
    link = lambda u: f"<a title='下一頁' href='{u}'>x</a>" if u else ""
    data = [("a", "1", link("2")), ("a", "2", link("9")), ("b", "1", link("2")), ("b", "2", link("1")), ("c", "5", ""), (None, "5", "")]
    got = pages.numbered(spark.createDataFrame(data, "g string, url string, html string"), "g", "url", "html")
    assert rows(got.where("g is not null")) == [("a", "1", 0), ("a", "2", 1), ("c", "5", 0)]


def test_adaptive_split_ends_with_days(spark):
    got = ranges.adaptive_split(spark, date(2024, 1, 1), date(2024, 12, 31), lambda c: c.withColumn("fetched", F.lit(10**6).cast("bigint")), 10, least_days=0)
    assert got.count() == 366 and got.where("chunk_start = chunk_end").count() == 366


def test_page_files_with_odd_names_and_ends(spark, tmp_path):
    data = [("臺北 113,訴/1:a", "<p>x</p>\n"), ("100%25 + a=b", ""), ("c" * 40, "a\n\nb 😀")]
    pages.write_files(spark.createDataFrame(data, "case_number string, html string"), f"file://{tmp_path}/f")
    got = {(r["html_file"], r["html"], r["bytes"]) for r in pages.read_files(spark, f"file://{tmp_path}/f").collect()}
    assert got == {("臺北_113_訴_1_a.html", "<p>x</p>\n", 9), ("100%25_+_a=b.html", "", 0), ("c" * 40 + ".html", "a\n\nb 😀", 9)}
