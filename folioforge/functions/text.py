"""Native column functions: normalising, cutting, keys in addresses, predicates.  None needs Python on executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+\z", "")


def collapse(x: Column | str) -> Column:
    """Runs of blanks (not newlines) as one space, ends trimmed."""
    return strip(F.regexp_replace(col(x), fixed.BLANKS, " "))


def squeeze(x: Column | str) -> Column:
    """Trimmed, then without any blanks: a section's bare title."""
    return F.regexp_replace(strip(x), fixed.BLANKS, "")


def cap(x: Column | str, most: int, mark: str = fixed.CUT_MARK) -> Column:
    """At most ``most`` code points, marked where cut."""
    return F.when(F.length(col(x)) > most, F.concat(F.substring(col(x), 1, most), F.lit(mark))).otherwise(col(x))


def first_nonempty(*xs: Column | str) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(col(x), F.lit("")) for x in xs], F.lit(""))


def cut_at(x: Column | str, regex: str) -> Column:
    """Up to the first match, trimmed; unchanged where there is none."""
    return F.when(col(x).rlike(regex), strip(F.get(F.split(col(x), regex, 2), F.lit(0)))).otherwise(col(x))


def strip_footer(x: Column | str) -> Column:
    return cut_at(x, "(?U)" + fixed.FOOTER)


def court_of(x: Column | str) -> Column:
    """The court's name at the head of a case number, else empty."""
    return strip(F.regexp_extract(col(x), "(?U)" + fixed.COURT, 1))


def url_key(url: Column | str) -> Column:
    """struct(year, type, number) of an address' id parameter; empty strings where it has fewer than four parts."""
    raw = F.regexp_extract(col(url), "id=([^&]*)", 1)
    p = F.split(F.coalesce(F.try_url_decode(raw), F.lit("")), ",")
    part = lambda i: F.when(F.size(p) >= 4, strip(F.get(p, F.lit(i)))).otherwise("")
    return F.struct(part(1).alias("year"), part(2).alias("type"), part(3).alias("number"))


def url_year(url: Column | str) -> Column:
    """The year in an address' id parameter as an int, null where there is none."""
    raw = F.regexp_extract(col(url), "id=([^&]*)", 1)
    p = F.split(F.coalesce(F.try_url_decode(raw), F.lit("")), ",")
    return F.when(F.size(p) >= 2, strip(F.get(p, F.lit(1))).try_cast("int"))


def page_title(html: Column | str) -> Column:
    """The title within the first 2000 characters, else empty."""
    return F.regexp_extract(F.substring(col(html), 1, 2000), r"(?s)<title>\s*(.*?)\s*</title>", 1)


def page_is_complete(html: Column | str, least: int = 5000, marks: tuple[str, ...] = ('id="jud"', "htmlcontent"), within: int | None = None, size: Column | str | None = None) -> Column:
    """Long enough (by ``size``, or by characters) and with one of the marks (in the first ``within`` characters, if given)."""
    seen = col(html) if within is None else F.substring(col(html), 1, within)
    length = F.length(col(html)) if size is None else col(size)
    return F.coalesce((length >= least) & reduce(lambda a, b: a | b, [seen.contains(m) for m in marks]), F.lit(False))


def title_matches_url(html: Column | str, url: Column | str) -> Column:
    """The page's title holds year, type and number of the address; true where either cannot be read."""
    title, key = F.regexp_replace(page_title(html), r"(?U)\s+", ""), url_key(url)
    whole = title.contains(key["year"]) & title.contains(key["type"]) & title.contains(key["number"])
    return F.when((key["year"] == "") | (title == ""), F.lit(True)).otherwise(whole)


def reject_reason(html: Column | str, url: Column | str, landed: Column | str | None = None) -> Column:
    """Why a fetched page is refused: stale (it shows another id than asked), mismatch, stub; null if it is fine."""
    out = F.lit(None).cast("string")
    out = F.when(~page_is_complete(html), "stub").otherwise(out)
    out = F.when(~title_matches_url(html, url), "mismatch").otherwise(out)
    if landed is not None:
        head = lambda u: F.substring(F.substring_index(col(u), "id=", -1), 1, 20)
        out = F.when(col(url).contains("id=") & (head(landed) != head(url)), "stale").otherwise(out)
    return out


def file_name(x: Column | str) -> Column:
    """A case number as a file name."""
    return F.regexp_replace(col(x), r'[\\/*?:"<>|,\s]', "_")


def judgment_kind(x: Column | str) -> Column:
    return F.when(col(x).contains("判決"), "判決").when(col(x).contains("裁定"), "裁定").when(F.coalesce(col(x), F.lit("")) != "", "其他").otherwise("")


def court_hint(x: Column | str) -> Column:
    return F.when(col(x).contains("法院"), col(x))


def date_hint(x: Column | str) -> Column:
    return F.when(col(x).rlike(fixed.DATE_HINT), col(x))


def in_years(year: Column | str, low: int, high: int) -> Column:
    """Within the years, or without a year."""
    return col(year).isNull() | col(year).between(low, high)


def like(x: Column, pattern: str) -> Column:
    """Whether a text is LIKE '%pattern%': ``%`` stands for any characters, ``_`` for one, nothing escapes them.

    The parts between ``%`` are looked for one behind the other, each where it first stands, so the time goes with the
    text's length and not, as a backtracking match's, with a power of it."""
    at: Column = F.when(x.isNotNull(), F.lit(1))
    for part in filter(None, pattern.split("%")):
        if "_" in part:
            regex = "(?s)" + "".join("." if c == "_" else rf"\x{{{ord(c):x}}}" for c in part)
            found = F.regexp_instr(F.substring(x, at, F.lit(2**31 - 1)), F.lit(regex))
            at = F.when(found > 0, at + found - 1 + len(part))
        else:
            found = F.position(F.lit(part), x, at)
            at = F.when(found > 0, found + len(part))
    return at.isNotNull()


def like_any(keyword: str, *xs: Column | str) -> Column:
    """One of the columns is LIKE '%keyword%', ASCII letters in either case."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in keyword)
    return reduce(lambda a, b: a | b, [like(low(col(x)), want) for x in xs])


def contains_any(needle: str, *xs: Column | str, fold: bool = False) -> Column:
    """One of the columns holds the text; fold: ASCII letters in either case."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = F.lit("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in needle) if fold else needle)
    return reduce(lambda a, b: a | b, [F.coalesce((low(col(x)) if fold else col(x)).contains(want), F.lit(False)) for x in xs])


def distinct_joined(values: Column, sep: str, most: int | None = None) -> Column:
    """Values without repeats, in the order of their first occurrence, joined."""
    out = F.array_join(F.array_distinct(values), sep)
    return out if most is None else F.substring(out, 1, most)


def cited_laws(*sources: Column | str) -> Column:
    """The citations in the clause "by ... as in the main text" near the end of the first source that has any."""
    def of(x: Column) -> Column:
        tail = F.when(F.length(x) > 3000, F.substring(x, -3000, 3000)).otherwise(x)
        clause = F.regexp_extract(tail, "(?sU)" + fixed.LAW_CLAUSE, 1)
        return distinct_joined(F.regexp_extract_all(clause, F.lit("(?U)" + fixed.LAW_CITE), F.lit(0)), "；", 1000)

    return first_nonempty(*[of(col(s)) for s in sources])


def law_appendix(x: Column | str) -> Column:
    """What follows the appendix' mark, trimmed, at most 3000 characters; empty without one."""
    regex = "(?U)" + fixed.LAW_APPENDIX
    return F.when(col(x).rlike(regex), F.substring(strip(F.get(F.split(col(x), regex, 2), F.lit(1))), 1, 3000)).otherwise("")


def roc_range(start: Column, end: Column, this_year: Column | int) -> Column:
    """struct(low, high) of ROC years for days of which one may be null or empty; both null where both are."""
    low, high = roc_year(F.nullif(start, F.lit(""))), roc_year(F.nullif(end, F.lit("")))
    some = low.isNotNull() | high.isNotNull()
    this = F.lit(this_year) if isinstance(this_year, int) else this_year
    return F.struct(F.when(some, F.coalesce(low, F.lit(fixed.FIRST_ROC_YEAR))).alias("low"), F.when(some, F.coalesce(high, this - 1911)).alias("high"))


def iso_day(x: Column | str) -> Column:
    """YYYY/MM/DD or YYYY-MM-DD as a date, null where it is none."""
    plain = F.replace(col(x).cast("string"), F.lit("/"), F.lit("-"))
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(plain, "yyyy-MM-dd"))


def output_name(keyword: Column | str, at: Column | str) -> Column:
    """The workbook's name for a keyword and a time."""
    return F.concat(F.lit("judgments_"), col(keyword), F.lit("_"), F.date_format(col(at), "yyyyMMdd_HHmmss"), F.lit(".xlsx"))


def roc_year(day: Column | str) -> Column:
    """The leading year of Y/M/D or Y-M-D, less 1911."""
    return F.get(F.split(F.replace(col(day).cast("string"), F.lit("/"), F.lit("-")), "-"), F.lit(0)).try_cast("int") - 1911
