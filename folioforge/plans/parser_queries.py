"""Registered queries for the rules of the judgments' parser: pages made from customers, each rule beside the SQL that
says what must come out of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import judgments
from . import search
from .queries import judgment_pages, query, table

DIGITS, NUMERALS = "0123456789", "甲乙丙丁戊己庚辛壬癸"
CLOSING = "上列當事人間請求給付事件，本院判決如下："
ROLE_LIST = "[" + ", ".join(f"'{r}'" for r, _ in fixed.ROLES) + "]"
FIELD_LIST = "[" + ", ".join(f"'{f}'" for _, f in fixed.ROLES) + "]"
K = "c_custkey"


def cjk(sur: str) -> Column:
    """A surname with the customer's number in ten characters that no role has."""
    return F.concat(F.lit(sur), F.translate(F.col(K).cast("string"), DIGITS, NUMERALS))


def cjk_sql(sur: str) -> str:
    return f"'{sur}' || translate(CAST({K} AS VARCHAR), '{DIGITS}', '{NUMERALS}')"


def choose(number: Column, cases: list[Column]) -> Column:
    """The case of that number."""
    return reduce(lambda out, i: F.when(number == i, cases[i]).otherwise(out), range(len(cases) - 2, -1, -1), cases[-1])


def lines(*xs: Column | str) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])


def divs(body: Column) -> Column:
    return F.array_join(F.transform(body, lambda x: F.when(x.startswith("##"), F.concat(F.lit("<div class='notEdit'>"), F.substring(x, 3, 1000), F.lit("</div>"))).otherwise(F.concat(F.lit("<div>"), x, F.lit("</div>")))), "")


def page(body: Column) -> Column:
    """Lines as a page's children; a line that begins with ## is a heading."""
    filler = F.lit("<span>" + "補" * 101 + "</span>")  # a container is taken from 101 characters on
    return F.concat(F.lit("<html><body><div class='jud_content'><div class='htmlcontent'><div class='he-h1 notEdit'>臺灣臺北地方法院民事判決</div>"), divs(body), filler, F.lit("</div></div></body></html>"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


def parsed(rows: DataFrame, html: Column, *shown: str, **hints: Column) -> DataFrame:
    pages = rows.select(F.col(K).alias("crawl_id"), html.alias("html"), *[v.alias(k) for k, v in hints.items()])
    return judgments.parse(pages).select("crawl_id", *shown)


PEOPLE = ["plaintiff", "plaintiff_agent", "defendant", "defendant_agent", "appellant", "appellant_agent", "appellee", "appellee_agent"]


def _people_sql() -> str:
    names = ", ".join(f"CASE WHEN field = '{f}' THEN names ELSE '' END AS {f}, CASE WHEN field = '{f}' THEN agents ELSE '' END AS {f}_agent" for f in fixed.FIELDS)
    return f"SELECT {K} AS crawl_id, {names}, roles AS party_roles FROM p"


# -- parties ----------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT {K}, {ROLE_LIST}[{K} % 34 + 1] AS role, {FIELD_LIST}[{K} % 34 + 1] AS field, ({K} // 34) % 5 AS f, ({K} // 170) % 4 AS g, {cjk_sql("王")} AS a, {cjk_sql("李")} AS b, {cjk_sql("陳")} AS x, {cjk_sql("林")} AS y FROM customer),
p AS (SELECT {K}, field, CASE WHEN f = 4 THEN a || '；' || b ELSE a END AS names, CASE g WHEN 0 THEN x WHEN 1 THEN x || '；' || y ELSE '' END AS agents,
CASE f WHEN 3 THEN role || '即原告：' || a WHEN 4 THEN role || '：' || a || '；' || role || '即被告：' || b ELSE role || '：' || a END AS roles FROM c) {_people_sql()}""")
def parse_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 34 roles; with a name, spaced out, alone before the name, compounded, and grown by a line; agents of three kinds."""
    k = F.col(K)
    role = F.element_at(F.array(*[F.lit(r) for r, _ in fixed.ROLES]), (k % 34 + 1).cast("int"))
    spaced = F.array_join(F.split(role, ""), " ")
    a, b, x, y = (cjk(s) for s in "王李陳林")
    party = choose(F.floor(k / 34) % 5, [
        lines(F.concat(role, F.lit("　"), a, F.lit("　住臺北市信義區"))), lines(F.concat(spaced, F.lit(" "), a, F.lit("（受託人）"))), lines(role, F.concat(a, F.lit("　設臺北市"))),
        lines(F.concat(role, F.lit("即原告 "), a)), lines(F.concat(role, F.lit(" "), a), F.concat(F.lit("即被告 "), b)),
    ])
    agent = choose(F.floor(k / 170) % 4, [lines(F.concat(F.lit("訴訟代理人　"), x, F.lit("律師"))), lines("上一人", F.concat(F.lit("法定代理人 "), x), F.concat(y, F.lit("律師"))), lines("輔佐人　某某"), lines("12 樓之 3", "及", "、")])
    return parsed(customers(spark, sf_dir), page(F.concat(party, agent, lines(CLOSING, "##主　文", "准。"))), *PEOPLE, "party_roles")


@query(f"""WITH c AS (SELECT {K}, {K} % 7 AS m, {cjk_sql("王")} AS a FROM customer),
p AS (SELECT {K}, CASE WHEN m IN (0, 1) THEN 'appellant' WHEN m = 2 THEN 'plaintiff' ELSE 'defendant' END AS field, CASE m WHEN 5 THEN '原來公司' WHEN 6 THEN a || '；' || a ELSE a END AS names, '' AS agents,
CASE m WHEN 0 THEN '再抗告人：' || a WHEN 1 THEN '上訴人即附帶被上訴人：' || a WHEN 2 THEN '聲請人：' || a WHEN 3 THEN '被告：' || a WHEN 4 THEN '相對人：' || a WHEN 5 THEN '債務人：原來公司' ELSE '債務人：' || a || '、' || a END AS roles FROM c) {_people_sql()}""")
def parse_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that are broken over short lines: put together with a name, with an agent's line, or not at all."""
    a = cjk("王")
    body = choose(F.col(K) % 7, [
        lines("再", "抗告", F.concat(F.lit("人  "), a)), lines("上訴", "人即附", "帶被", "上訴人", a), lines("聲請人即", F.concat(F.lit("原告訴訟代理人　"), a, F.lit("律師"))), lines("原", "住址一號", "被告", a),
        lines("相", "對", "人", F.concat(a, F.lit("　住臺北市"))), lines("債務人", "原來公司"), lines("債務", "人", a, a),
    ])
    return parsed(customers(spark, sf_dir), page(F.concat(body, lines(CLOSING, "##主　文", "准。"))), *PEOPLE, "party_roles")


# -- sections ---------------------------------------------------------------------------------------

DATED = "中　華　民　國　113　年　5　月　1　日"


@query(f"""WITH c AS (SELECT {K}, {K} % 5 AS m, {cjk_sql("王")} AS a, c_name AS n, c_mktsegment AS s FROM customer),
x AS (SELECT *, CASE WHEN m = 4 THEN '' ELSE '主 文' || chr(10) || n || chr(10) || '第二 句。' || chr(10) || ['事實及理由', '理 由', '犯罪事實', '據上論斷'][m + 1] || chr(10) END AS mid FROM c)
SELECT {K} AS crawl_id, a AS plaintiff, CASE m WHEN 4 THEN n || chr(10) || s ELSE n || chr(10) || '第二 句。' END AS verdict, CASE m WHEN 0 THEN s ELSE '' END AS facts_and_reasons, CASE m WHEN 1 THEN s ELSE '' END AS reasons,
CASE m WHEN 2 THEN s ELSE '' END AS criminal_facts, CASE m WHEN 3 THEN s ELSE '' END AS conclusion, '張文山' AS judges, '林美玉' AS clerk,
md5('臺灣臺北地方法院民事判決' || chr(10) || '原 告 ' || a || chr(10) || '{CLOSING}' || chr(10) || mid || CASE m WHEN 4 THEN n || chr(10) ELSE '' END || s || chr(10) || '{DATED.replace("　", " ")}' || chr(10) || '法 官 張文山' || chr(10) || '書記官 林美玉') AS full_md5 FROM x""")
def parse_text_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of plain lines: exact headings, a heading without text, the stop at the date, and no heading at all."""
    n, s, m = F.col("c_name"), F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")), F.col(K) % 5
    head = lines("臺灣臺北地方法院民事判決", F.concat(F.lit("原　告　"), cjk("王")), CLOSING)
    titled = F.concat(lines("  主　文", n, "第二　 句。", ""), F.array(choose(m, [F.lit(x) for x in ("事實及理由", "理　由", "犯罪事實", "據上論斷")])), F.array(s))
    body = F.concat(head, F.when(m == 4, F.array(n, s)).otherwise(titled), lines(DATED, "法　官　張文山", "書記官　林美玉"))
    html = F.concat(F.lit("<html><body><div class='jud_content'><div class='text-pre'>"), F.array_join(body, "\n"), F.lit("</div></div></body></html>"))
    got = parsed(customers(spark, sf_dir), html, "plaintiff", "verdict", "facts_and_reasons", "reasons", "criminal_facts", "conclusion", "judges", "clerk", "full_text")
    return got.withColumn("full_md5", F.md5("full_text")).drop("full_text")


_CITED = "'民法第 ' || CAST(k AS VARCHAR) || ' 條；刑法第 9 條'"


@query(f"""WITH c AS (SELECT {K}, {K} AS k, {K} % 6 AS t, ({K} // 6) % 4 AS a, c_name AS n FROM customer),
x AS (SELECT *, n || CASE a WHEN 2 THEN chr(10) || '依民法第 ' || CAST(k AS VARCHAR) || ' 條、民法第 ' || CAST(k AS VARCHAR) || ' 條、刑法第 9 條，判決如主文。' ELSE '' END AS body, CASE WHEN a = 1 THEN '依民法第 ' || CAST(k AS VARCHAR) || ' 條、刑法第 9 條，判決如主文。' ELSE '' END AS upon FROM c)
SELECT {K} AS crawl_id, '准。' AS verdict, CASE WHEN t < 3 THEN body ELSE '' END AS facts_and_reasons, CASE t WHEN 3 THEN n ELSE '' END AS facts, CASE t WHEN 3 THEN body WHEN 4 THEN body WHEN 5 THEN '其一。' || chr(10) || body ELSE '' END AS reasons,
CASE t WHEN 4 THEN n ELSE '' END AS criminal_facts, CASE WHEN t = 5 THEN '' ELSE upon END AS conclusion,
CASE WHEN a = 0 THEN '刑法第 339 條' || chr(10) || n WHEN a = 1 OR a = 2 AND t IN (0, 3, 5) THEN {_CITED} ELSE '' END AS applicable_laws FROM x""")
def parse_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that stand in for each other, a title that comes again, one without text; cited laws by source, and an appendix."""
    k, n = F.col(K), F.col("c_name")
    t, a = k % 6, F.floor(k / 6) % 4
    law = F.concat(F.lit("民法第 "), k.cast("string"), F.lit(" 條"))
    cite = F.when(a == 2, F.array(F.concat(F.lit("依"), law, F.lit("、"), law, F.lit("、刑法第 9 條，判決如主文。")))).otherwise(F.expr("cast(array() as array<string>)"))
    titled = choose(t, [
        F.concat(lines("##事實及理由", n), cite), F.concat(lines("##事實暨理由", n), cite), F.concat(lines("##事實與理由", n), cite), F.concat(lines("##事　實", n, "##理　由", n), cite),
        F.concat(lines("##犯罪事實", n, "##認定犯罪事實所憑之證據及理由", n), cite), F.concat(lines("##理　由", "其一。", "##結　論", "##理　由", n), cite),
    ])
    upon = F.when(a == 1, F.array(F.lit("##據上論斷"), F.concat(F.lit("依"), law, F.lit("、刑法第 9 條，判決如主文。")))).otherwise(F.expr("cast(array() as array<string>)"))
    after = F.when(a == 0, F.array(F.lit("附錄本案論罪科刑法條全文：刑法第 339 條"), n)).otherwise(F.expr("cast(array() as array<string>)"))
    body = F.concat(lines(F.concat(F.lit("原告 "), cjk("王")), CLOSING, "##主　文", "准。"), titled, upon, lines(DATED), after)
    return parsed(customers(spark, sf_dir), page(body), "verdict", "facts_and_reasons", "facts", "reasons", "criminal_facts", "conclusion", "applicable_laws")


@query(f"""WITH c AS (SELECT {K}, {K} % 7 AS m, '王' || translate(CAST({K} % 1000 AS VARCHAR), '{DIGITS}', '{NUMERALS}') AS a FROM customer)
SELECT {K} AS crawl_id, CASE m WHEN 0 THEN a || '；李小華；張文山' WHEN 3 THEN '' WHEN 6 THEN '' ELSE a END AS judges, CASE WHEN m IN (3, 5, 6) THEN '' ELSE '林美玉' END AS clerk FROM c""")
def parse_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel, an earlier mention far before, a judge twice, noise, a spaced name with what follows, a clerk too far off, none."""
    a = F.concat(F.lit("王"), F.translate((F.col(K) % 1000).cast("string"), DIGITS, NUMERALS))
    clerk, one = F.lit("書 記 官　林　美　玉"), F.concat(F.lit("法　官　"), a)
    signed = choose(F.col(K) % 7, [
        lines(F.concat(F.lit("審判長法　官　"), a), "法　官　李小華", "法　官　張文山", clerk), lines("法 官 舊人一", "。" * 310, one, clerk), lines(one, one, clerk), lines("法官 獨任審理", clerk),
        lines(F.concat(F.lit("法　官　王　"), F.array_join(F.split(F.substring(a, 2, 9), ""), "　"), F.lit(" 以上正本")), clerk), lines(one, "。" * 620, clerk), lines(clerk),
    ])
    return parsed(customers(spark, sf_dir), page(F.concat(lines("原告 某人", CLOSING, "##主　文", "准。", DATED), signed)), "judges", "clerk")


# -- metadata and caps ------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT {K}, CASE {K} % 5 WHEN 0 THEN '臺灣新竹地方法院 113 年度訴字第 ' || CAST({K} AS VARCHAR) || ' 號民事判決' WHEN 1 THEN '憲法法庭 112 年憲判字第 ' || CAST({K} AS VARCHAR) || ' 號判決' WHEN 2 THEN '某案 ' || CAST({K} AS VARCHAR) || ' 裁定' WHEN 3 THEN CAST({K} AS VARCHAR) ELSE '' END AS num,
['臺北地方法院', '憲法法庭', '', 'x'][({K} // 5) % 4 + 1] AS hint, ['113.05.01', '113年5月', 'May', ''][({K} // 20) % 4 + 1] AS day FROM customer)
SELECT {K} AS crawl_id, num AS case_number, CASE WHEN contains(hint, '法院') THEN hint WHEN {K} % 5 = 0 THEN '臺灣新竹地方法院' WHEN {K} % 5 = 1 THEN '憲法法庭' ELSE '' END AS court, CASE WHEN day IN ('May', '') THEN '' ELSE day END AS judgment_date,
CASE WHEN contains(num, '判決') THEN '判決' WHEN contains(num, '裁定') THEN '裁定' WHEN num <> '' THEN '其他' ELSE '' END AS judgment_type FROM c""")
def parse_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a head table: number, court and date from hints, where they are valid, or from each other."""
    k, n = F.col(K), F.col(K).cast("string")
    num = choose(k % 5, [F.concat(F.lit("臺灣新竹地方法院 113 年度訴字第 "), n, F.lit(" 號民事判決")), F.concat(F.lit("憲法法庭 112 年憲判字第 "), n, F.lit(" 號判決")), F.concat(F.lit("某案 "), n, F.lit(" 裁定")), n, F.lit("")])
    court, day = choose(F.floor(k / 5) % 4, [F.lit(x) for x in ("臺北地方法院", "憲法法庭", "", "x")]), choose(F.floor(k / 20) % 4, [F.lit(x) for x in ("113.05.01", "113年5月", "May", "")])
    return parsed(customers(spark, sf_dir), page(lines("准。")), "case_number", "court", "judgment_date", "judgment_type", case_number_hint=num, court_hint=court, date_hint=day)


@query(f"""SELECT {K} AS crawl_id, '臺灣臺北地方法院 ' || CAST({K} AS VARCHAR) || ' 號' AS case_number, CASE WHEN {K} % 2 = 0 THEN '最高法院' ELSE '臺灣臺北地方法院' END AS court, c_mktsegment AS judgment_date, CASE WHEN {K} % 3 = 0 THEN '後者' ELSE c_name END AS case_type FROM customer""")
def parse_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels belong to the next value beside them, with or without a colon; a court of its own wins, and so do later labels."""
    k = F.col(K)
    cell = lambda label, value, between="": F.concat(F.lit(f"<div class='col-th'>{label}</div>{between}<div class='col-td'>"), value, F.lit("</div>"))
    head = F.concat(
        F.lit("<div id='jud' class='int-table'>"), cell("裁判字號：", F.concat(F.lit("臺灣臺北地方法院 "), k.cast("string"), F.lit(" 號"))), F.when(k % 2 == 0, cell("裁判法院", F.lit("最高法院"))).otherwise(""),
        cell("裁判日期:", F.concat(F.lit("　"), F.col("c_mktsegment"), F.lit("\t ")), "<div class='x'>no value</div>"), cell("案件類型：", F.col("c_name")), F.when(k % 3 == 0, cell("裁判案由：", F.lit("後者"))).otherwise(""), F.lit("</div>"),
    )
    return parsed(customers(spark, sf_dir), F.concat(F.lit("<html><body>"), head, page(lines("准。")), F.lit("</body></html>")), "case_number", "court", "judgment_date", "case_type")


_CAPPED = [("verdict", "主文"), ("facts", "事實"), ("facts_and_reasons", "事實及理由"), ("criminal_facts", "犯罪事實"), ("reasons", "理由"), ("conclusion", "結論")]
_SIZES = ", ".join(f"CASE WHEN d > 0 THEN {fixed.CAPS[f]} + {len(fixed.CUT_MARK)} ELSE {fixed.CAPS[f]} + d END AS {f}" for f, _ in _CAPPED)


@query(f"SELECT CAST(r_regionkey AS BIGINT) AS crawl_id, {_SIZES}, d > 0 AS marked, {fixed.CAPS['applicable_laws']} AS applicable_laws, {fixed.CAPS['full_text']} + {len(fixed.CUT_MARK)} AS full_text FROM (SELECT r_regionkey, r_regionkey - 2 AS d FROM region)")
def parse_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections around their caps, from two characters under to two over; appendix and whole text far over theirs."""
    more = F.col("r_regionkey") - 2
    body = F.concat(*[F.array(F.lit(f"##{title}"), F.expr(f"repeat('字', cast({fixed.CAPS[f]} + r_regionkey - 2 as int))")) for f, title in _CAPPED], lines(DATED, F.concat(F.lit("附錄法條："), F.expr(f"repeat('法', {fixed.CAPS['applicable_laws'] + 500})"))))
    pages = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("crawl_id"), page(body).alias("html"))
    got = judgments.parse(pages)
    sizes = [F.length(f).alias(f) for f in [f for f, _ in _CAPPED] + ["applicable_laws", "full_text"]]
    return got.select("crawl_id", *sizes, F.col("verdict").endswith(fixed.CUT_MARK).alias("marked"))


# -- export and rejects -----------------------------------------------------------------------------

_CUT = lambda x, n, m=fixed.CUT_MARK: f"CASE WHEN length({x}) > {n} THEN {x}[1:{n}] || '{m}' ELSE {x} END"
_FLAT = "list_filter(list_transform(string_split(text, chr(10))[2:], lambda x: regexp_replace(regexp_replace(x, '[　  \t]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '')"


@query(f"""SELECT doc_id AS crawl_id, md5(concat_ws('|', '臺灣臺北地方法院 113 年度訴字第 ' || CAST(doc_id AS VARCHAR) || ' 號民事判決', '', '臺灣臺北地方法院', '民國 113 年 5 月 1 日', source, '判決', '原告：王大明；被告：李小華', '王大明', '陳志明', '李小華', '', '', '', '', '', {_CUT("v", 10000)}, '', '', '',
{_CUT(f"({_CUT('r', 50000)})", fixed.CELL_CAP)}, '', '民法第 148 條；民事訴訟法第 78 條', '張文山', '林美玉', '借名', '2024-01-02 03:04:05')) AS row_md5, 26 AS n_columns
FROM (SELECT *, trim(regexp_replace(string_split(text, chr(10))[1], '[　  \t]+', ' ', 'g')) AS v, array_to_string(list_concat({_FLAT}, ['據上論結，依民法第 148 條、民事訴訟法第 78 條，判決如主文。']), chr(10)) AS r FROM documents)""")
def judgment_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's 26 columns, in order, of parsed pages."""
    got = judgments.parse(judgment_pages(spark, sf_dir)).withColumn("parsed_at", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    columns = search.export_columns()
    keyed = search.cells(got, [("crawl_id", "crawl_id"), *columns])
    return keyed.select(F.col("crawl_id").cast("bigint").alias("crawl_id"), F.md5(F.concat_ws("|", *[f"`{label}`" for _, label in columns])).alias("row_md5"), F.lit(len(columns)).alias("n_columns"))


@query(f"SELECT {K} % 4 = 3 AS rejected, count(*) AS n, CASE WHEN {K} % 4 = 3 THEN 'AssertionError' END AS kind FROM customer GROUP BY 1, 3")
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that cannot be read is a row of its own with the reason; the others are parsed."""
    html = F.when(F.col(K) % 4 == 3, F.lit("<html><![odd[x]]><body>")).otherwise(page(lines("原告 某人", CLOSING, "##主　文", "准。")))
    got = parsed(customers(spark, sf_dir), html, "verdict", "error")
    bad = F.col("error").isNotNull()
    return got.where(bad | (F.col("verdict") == "准。")).groupBy(bad.alias("rejected"), F.regexp_extract("error", "^([^:]+)", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
