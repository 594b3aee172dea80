"""Fixed values of the legal-page domain: what must be equal for equal results."""

# Party roles and the field each belongs to, longer roles before their parts.
ROLES = [
    ("反聲請聲請人", "plaintiff"),
    ("反聲請相對人", "defendant"),
    ("再審聲請人", "appellant"),
    ("再審原告", "plaintiff"),
    ("附帶被上訴人", "appellee"),
    ("附帶上訴人", "appellant"),
    ("被上訴人", "appellee"),
    ("再審被告", "defendant"),
    ("反反請求原告", "plaintiff"),
    ("反反請求被告", "defendant"),
    ("反請求原告", "plaintiff"),
    ("反請求被告", "defendant"),
    ("反訴原告", "plaintiff"),
    ("反訴被告", "defendant"),
    ("主參加原告", "plaintiff"),
    ("主參加被告", "defendant"),
    ("追加原告", "plaintiff"),
    ("追加被告", "defendant"),
    ("受裁定人", "plaintiff"),
    ("公訴人", "plaintiff"),
    ("自訴人", "plaintiff"),
    ("再抗告人", "appellant"),
    ("原告", "plaintiff"),
    ("聲請人", "plaintiff"),
    ("申請人", "plaintiff"),
    ("告訴人", "plaintiff"),
    ("債權人", "plaintiff"),
    ("被告", "defendant"),
    ("受刑人", "defendant"),
    ("債務人", "defendant"),
    ("上訴人", "appellant"),
    ("抗告人", "appellant"),
    ("異議人", "appellant"),
    ("相對人", "defendant"),
]
FIELDS = ["plaintiff", "appellant", "appellee", "defendant"]

# Expressions over judgment texts.
BLANKS = "[　  \t]+"
COURT = r"^(.*?(?:憲法法庭|少年及家事法院|地方法院|高等法院|最高行政法院|最高法院|高等行政法院|行政法院|智慧財產及商業法院|智慧財產法院|海事法院)(?:\s+\S+分院|\s+地方庭)?)"
NAME_STOP = r"(?:住|設|居|籍|（|\(|訴訟\s*代理|辯護|法定\s*代理|複\s*代理|輔佐|律師)"
AGENT = r"^(?:訴訟\s*代理\s*人|法定\s*代理\s*人|複\s*代理\s*人|特別\s*代理\s*人|送達\s*代收\s*人|選任\s*辯護\s*人|指定\s*辯護\s*人|辯護\s*人|代\s*理\s*人)\s*(.+)"
PREAMBLE_STOP = r"中\s*華\s*民\s*國\s*\d{2,3}\s*年|以上正本證明|書記官\s*\S|如不服本(?:判決|裁定)"
FOOTER = r"(?:中\s*華\s*民\s*國\s*\d{2,3}\s*年|以上正本證明|如不服本(?:判決|裁定)|本件判決確定)"
INTRO = r"(?:如下|以下)\s*[：:]?\s*$"
GROUP_MARK = r"^(?:[上前]\s*(?:[〇一二三四五六七八九十百千萬]+\s*人|列)|共\s*同)"
AGENT_NAMED = r"(?:代\s*理\s*人|辯護\s*人)\s+(.+)"
NAME_JOINS, AGENT_JOINS = r"[即及與，,、；;。\s]+", r"[兼及與、，,；;。\s]+"
BRACKETED, LAWYER, ASSISTANT, NOT_A_NAME = r"[（(][^）)]*[）)]", "律師|辯護", "輔佐", r"[\d\sA-Za-z]"
FRAGMENT_MOST, NAME_MOST, ALSO, SENTENCE = 8, 20, "即", "上列"
LAW_APPENDIX = r"(?:附錄(?:本案)?(?:論罪科刑)?法條(?:全文)?|所犯法條)\s*[：:]\s*(?!分敘)"
LAW_CLAUSE = r"依\s*(.{1,300}?)\s*[,，]\s*(?:判決|裁定)如主文"
LAW_CITE = r"(?:[^\s，；、（\(]{1,15}(?:法|條例|規則))\s*第\s*[\d百千一二三四五六七八九十]+\s*條[之第\d\s]*"
CJK_NAME = "([一-鿿](?:[^\\S\\n]*[一-鿿]){1,5})"
JUDGE_NOISE = "獨任|審理|書記|主任|股長|庭長"
NAME_TAIL = "(?:以上|附表|附件|附錄|正本|如不|書記|係照|據上|所犯|中華)"
HEADING_CHARS = "主文事實理由結論法條犯罪據上聲明陳述附"
PLAIN_HEADINGS = ["主文", "理由", "事實及理由", "事實", "犯罪事實", "結論", "據上論斷"]
DATE_HINT = r"\d{2,3}[./年]\d{1,2}"

# The table of parsed records, in order, and the export's labels.
JUDGMENT_FIELDS = [
    "case_number", "court", "judgment_date", "case_type", "judgment_type", "source_url", "verdict", "facts", "facts_and_reasons", "criminal_facts", "reasons", "conclusion", "applicable_laws", "judges", "clerk",
    "plaintiff", "plaintiff_agent", "defendant", "defendant_agent", "appellant", "appellant_agent", "appellee", "appellee_agent", "party_roles", "other_parties", "full_text", "keyword",
]
CAPS = {"verdict": 10000, "facts": 30000, "facts_and_reasons": 50000, "criminal_facts": 30000, "reasons": 50000, "conclusion": 5000, "applicable_laws": 3000, "full_text": 100000}
CELL_CAP = 32700
CUT_MARK = "…(截斷)"
UNKNOWN = "（未知）"
EXPORT = [
    ("case_number", "裁判字號"),
    ("source_url", "裁判書連結"),
    ("court", "法院"),
    ("judgment_date", "裁判日期"),
    ("case_type", "案件類型"),
    ("judgment_type", "裁判種類"),
    ("party_roles", "當事人角色"),
    ("plaintiff", "原告／聲請人"),
    ("plaintiff_agent", "原告代理人"),
    ("defendant", "被告／相對人"),
    ("defendant_agent", "被告代理人"),
    ("appellant", "上訴人"),
    ("appellant_agent", "上訴人代理人"),
    ("appellee", "被上訴人"),
    ("appellee_agent", "被上訴人代理人"),
    ("verdict", "主文"),
    ("facts", "事實"),
    ("facts_and_reasons", "事實及理由"),
    ("criminal_facts", "犯罪事實"),
    ("reasons", "理由"),
    ("conclusion", "結論"),
    ("applicable_laws", "適用法條"),
    ("judges", "法官"),
    ("clerk", "書記官"),
    ("keyword", "搜尋關鍵字"),
    ("parsed_at", "解析時間"),
]
FULL_TEXT = ("full_text", "全文")
RESULT_LIMIT, MIN_SPLIT_DAYS = 1900, 7
MOST_A_CALL, FIRST_ROC_YEAR = 2000, 104

# The table of fetched pages (name, type), and what leads from a result page to the next.
CRAWL_RECORDS = [("id", "bigint"), ("case_number", "string"), ("court", "string"), ("case_title", "string"), ("judgment_date", "string"), ("source_url", "string"), ("html_file", "string"), ("keyword", "string"), ("crawled_at", "timestamp"), ("parsed", "int")]
NEXT_PAGE, NEXT_CLASS, NEXT_PART = "下一頁", "page-next", "nextpage"
