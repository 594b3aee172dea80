from pyspark.sql import functions as F

from folioforge.functions import text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_blanks(spark):
    assert one(spark, text.squeeze("a"), a="主　文") == "主文"
    assert one(spark, text.collapse("a"), a="　a \t\xa0b\nc　") == "a b\nc"


def test_cap(spark):
    assert one(spark, text.cap("a", 3), a="漢字😀x") == "漢字😀…(截斷)"
    assert one(spark, text.cap("a", 4), a="漢字😀x") == "漢字😀x"
    assert one(spark, text.cap("a", 3), a=None) is None


def test_first_nonempty(spark):
    assert one(spark, text.first_nonempty("a", "b"), a="", b=None) == ""
    assert one(spark, text.first_nonempty("a", "b"), a="", b="x") == "x"


def test_footer(spark):
    assert one(spark, text.strip_footer("a"), a="內容 \n中　華 民 國 113 年 5 月") == "內容"
    assert one(spark, text.strip_footer("a"), a=" 內容 ") == " 內容 "


def test_court(spark):
    assert one(spark, text.court_of("a"), a="臺灣新竹地方法院 113 年度訴字") == "臺灣新竹地方法院"
    assert one(spark, text.court_of("a"), a="臺灣高等法院 臺中分院 112 年度") == "臺灣高等法院 臺中分院"
    assert one(spark, text.court_of("a"), a="憲法法庭 112 年憲判字") == "憲法法庭"
    assert one(spark, text.court_of("a"), a="no court") == ""


def test_url_key(spark):
    assert tuple(one(spark, text.url_key("a"), a="x?id=SCDV%2c115%2c消債更%2c37%2c2&b=1")) == ("115", "消債更", "37")
    assert tuple(one(spark, text.url_key("a"), a="x?id=SCDV,115")) == ("", "", "")
    assert tuple(one(spark, text.url_key("a"), a="x?id=%zz")) == ("", "", "")
    assert one(spark, text.url_year("a"), a="id=TPHV,112,上,750,20260422") == 112
    assert one(spark, text.url_year("a"), a="id=TPHV,abc") is None


def test_page_checks(spark):
    page = '<html><title> 112 年度 訴 字第 37 號 </title><div id="jud">' + "x" * 5000
    assert one(spark, text.page_is_complete("a"), a=page) is True
    assert one(spark, text.page_is_complete("a"), a=page[:3000]) is False
    assert one(spark, text.page_is_complete("a"), a=None) is False
    late = "x" * 20_000 + "htmlcontent"
    assert one(spark, text.page_is_complete("a"), a=late) is True
    assert one(spark, text.page_is_complete("a", within=20_000), a=late) is False
    assert one(spark, text.page_is_complete("a", size=F.octet_length("a")), a="htmlcontent" + "中" * 1700) is True
    assert one(spark, text.title_matches_url("a", "b"), a=page, b="id=A,112,訴,37") is True
    assert one(spark, text.title_matches_url("a", "b"), a=page, b="id=A,113,訴,37") is False
    assert one(spark, text.title_matches_url("a", "b"), a="<p>", b="id=A,113,訴,37") is True


def test_reject_reason(spark):
    page = "<title>112訴37</title>htmlcontent" + "x" * 5000
    reason = text.reject_reason("a", "b", "c")
    assert one(spark, reason, a=page, b="id=A,112,訴,37", c="id=A,112,訴,37") is None
    assert one(spark, reason, a=page, b="id=A,112,訴,37", c="id=B,112,訴,37") == "stale"
    assert one(spark, reason, a=page, b="id=A,113,訴,37", c="id=A,113,訴,37") == "mismatch"
    assert one(spark, reason, a="", b="id=A,113,訴,37", c="id=A,113,訴,37") == "stub"


def test_names_and_kinds(spark):
    assert one(spark, text.file_name("a"), a='a/b\\c*d?e:f"g<h>i|j,k l') == "a_b_c_d_e_f_g_h_i_j_k_l"
    assert one(spark, text.judgment_kind("a"), a="x裁定判決") == "判決"
    assert one(spark, text.judgment_kind("a"), a="") == ""
    assert one(spark, text.contains_any("TiOn%", "a", fold=True), a="xTIon%y") is True
    assert one(spark, text.roc_year("a"), a="2024/05/01") == 113


def test_laws(spark):
    body = "前文第1條。據上論結，依民法第148條、刑法第339條之4、民法第148條,判決如主文。"
    assert one(spark, text.cited_laws("a", "b"), a="none", b=body) == "民法第148條；刑法第339條之4"
    assert one(spark, text.law_appendix("a"), a="x附錄本案論罪科刑法條全文：\n刑法第1條 ") == "刑法第1條"
    assert one(spark, text.law_appendix("a"), a="所犯法條：分敘如下") == ""
