"""Secret scans with multipart credential linking, in DataFrame functions only.

Each kind's matches are found by one regular expression; the text between matches (``split``) and
the matches (``regexp_extract_all``) have the same order, so the running sum of their lengths gives
every match its place.  Beside the base kinds (assign, access, hex) there are weak candidates: words
that look like identifiers, long mixed words that look like secrets, and endpoints.  An interval join
within a document links a weak candidate to parts of another role that stand within ``SCOPE`` code
points of it; weak candidates without such a part are not reported.

The join is by document row and by stretches of ``SCOPE`` code points, in all of which a part stands
that it reaches; a stretch holds a bounded number of parts, so no document and no group of documents makes it quadratic.

Defined cases: a null or empty text has no spans; repeated rows are scanned each on its own; an empty
table gives an empty result; further columns are not read by :func:`spans` and kept by
:func:`redact`; matches and places cover whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SCOPE = 200
KINDS = ("assign", "access", "hex", "link_identifier", "link_secret", "link_endpoint")

_NAMES = "password|passwd|secret|token|api_?key"
# The base kinds' expressions.
ASSIGN = rf"(?i:({_NAMES}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
# Weak candidates, whole runs of their characters; only what surrounds them (blanks, a scheme's name) is bounded.
IDENTIFIER = r"(?i:(?:access|client|account|user|key)[_-]?(?:key[_-]?)?id)[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?([A-Za-z0-9_.@-]{4,})"
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"(?i:[a-z][a-z0-9+.-]{1,15}://)[A-Za-z0-9._~:/?@!&*+,;=%-]{4,}"


def _found(text: Column, kind: int, regex: str, gate: Column, group: int, least: int, more: Column | None = None) -> Column:
    """The matches of a kind: kind, i, gap (code points since the match before), n (its own), ok."""
    whole, part = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    gaps = F.split(text, regex, -1)
    rows = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"))), part, lambda x, p: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), p.alias("p")))
    kept = F.filter(rows, lambda x: x["m"].isNotNull())

    def row(x: Column, i: Column) -> Column:
        ok = F.length(x["p"]) >= least
        if more is not None:
            ok = ok & more(x["m"])
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].cast("bigint").alias("gap"), F.length(x["m"]).cast("bigint").alias("n"), ok.alias("ok"))

    return F.when(gate, F.transform(kept, row)).otherwise(F.expr("cast(array() as array<struct<kind:int,i:int,gap:bigint,n:bigint,ok:boolean>>)"))


def _mixed(m: Column) -> Column:
    """Upper and lower case letters and digits: not a word, not a number."""
    return m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")


def parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, and for each match that holds kind, start, stop; one row without a kind for a row without matches."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    sign = t.contains(":") | t.contains("=")
    found = F.concat(
        _found(t, 0, ASSIGN, sign & t.rlike(f"(?i:{_NAMES})"), 2, 6),
        _found(t, 1, ACCESS, t.contains("AKIA"), 0, 20),
        _found(t, 2, HEX.replace("+", "{24,}"), t.rlike("[0-9a-f]{24}"), 0, 24),  # a run of 24 or more is one match either way
        _found(t, 3, IDENTIFIER, sign & t.rlike("(?i:id)[\"']?\\x20{0,4}[:=]"), 1, 4),
        _found(t, 4, SECRET, t.rlike("[A-Za-z0-9+/_-]{32}"), 0, 32, _mixed),
        _found(t, 5, ENDPOINT, t.contains("://"), 0, 8),
    )
    one = src.select("row", "key", F.explode_outer(found).alias("m")).select("row", "key", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.col("n")).over(before)
    ok = F.col("ok")  # a row whose matches all fail, or that has none, still has to be there
    some = one.withColumn("stop", stop).select("row", "key", F.when(ok, F.col("kind")).alias("kind"), F.when(ok, F.col("stop") - F.col("n")).alias("start"), F.when(ok, F.col("stop")).alias("stop"))
    return stage(some, "parts")


def _role(kind: str) -> Column:
    """0 identifier, 1 secret, 2 endpoint."""
    return F.when(F.col(kind).isin(1, 3), 0).when(F.col(kind).isin(0, 2, 4), 1).when(F.col(kind) == 5, 2)


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates of :func:`parts` with a complementary part within ``scope``; a weak secret needs an
    identifier or endpoint, a weak identifier a secret, an endpoint an identifier and no less than a secret."""
    p = found.where("kind is not null").withColumn("role", _role("kind"))
    # both sides are dealt to all stretches they reach, however long; a pair may meet in several, which the maxima below do not mind
    weak = p.where("kind >= 3").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("stop") / scope))))
    other = p.select("row", F.col("role").alias("role2"), F.col("start").alias("start2"), F.col("stop").alias("stop2"))
    reach = F.sequence(F.floor((F.col("start2") - scope) / scope), F.floor((F.col("stop2") + scope) / scope))
    other = other.withColumn("bucket", F.explode(reach))
    near = (F.col("role") != F.col("role2")) & (F.col("start2") <= F.col("stop") + scope) & (F.col("stop2") >= F.col("start") - scope)
    pairs = weak.join(other, ["row", "bucket"]).where(near)
    roles = pairs.groupBy("row", "key", "kind", "start", "stop").agg(F.max((F.col("role2") == 0).cast("int")).alias("ident"), F.max((F.col("role2") == 1).cast("int")).alias("sec"), F.max((F.col("role2") == 2).cast("int")).alias("end"))
    holds = F.when(F.col("kind") == 4, (F.col("ident") + F.col("end")) > 0).when(F.col("kind") == 3, F.col("sec") > 0).otherwise((F.col("ident") > 0) & (F.col("sec") > 0))
    return roles.where(holds).select("row", "key", "kind", "start", "stop")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: row, key, spans (array of start, kind, stop, in that order), base kinds and reported weak ones."""
    found = parts(docs, key, text)
    rows = found.where("kind is null or kind < 3").unionByName(linked(found, scope)).unionByName(found.where("kind >= 3").select("row", "key", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop")))
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "stop"))
    return rows.groupBy("row").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(one)).alias("spans"))


def words(spans_: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _stretches(found: DataFrame) -> DataFrame:
    """row, key, cut: the spans of each row of :func:`spans` united to disjoint stretches (start, stop), in order."""
    flat = found.select("row", "key", F.explode("spans").alias("s")).select("row", "key", "s.start", "s.stop")
    order = Window.partitionBy("row").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flat = flat.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    flat = flat.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = flat.groupBy("row", "island").agg(F.first("key").alias("key"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return one.groupBy("row").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cut"))


#: Texts are masked in chunks of so many code points, so that a text with many stretches is not searched from its start for each.
CHUNK = 4096


def _masked(chunk: Column, base: Column, cut: Column, mask: str) -> Column:
    """A chunk that begins at ``base`` without what the stretches cover; a mask stands where a stretch begins."""
    inside = F.filter(cut, lambda x: (x["start"] < base + CHUNK) & (x["stop"] > base))

    def part(i: Column) -> Column:
        here, before = F.get(inside, i), F.get(inside, i - 1)
        a = F.when(i == 0, F.lit(0)).otherwise(before["stop"] - base)
        b = F.when(i == F.size(inside), F.lit(CHUNK)).otherwise(F.greatest(here["start"] - base, F.lit(0)))
        kept = F.substring(chunk, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
        return F.concat(kept, F.when(here["start"] >= base, F.lit(mask)).otherwise(""))

    return F.when(F.size(inside) == 0, chunk).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size(inside)), part), ""))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE, mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each stretch that spans cover replaced by ``mask``; n_chars, if there is one, follows the text.

    Spans meet their text by (key, hash of the text): rows equal in both have equal spans."""
    hashed = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("hash"), F.col(f"`{text}`").alias("text"))
    found = spans(hashed.select(F.struct("key", "hash").alias("id"), "text"), "id", "text", scope).where(F.size("spans") > 0)
    found = _stretches(found).groupBy(F.col("key.key").alias("_key"), F.col("key.hash").alias("_hash")).agg(F.first("cut").alias("_cut"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, k = docs.columns.index(text), docs.columns.index(key)
    wide = docs.toDF(*names)
    joined = wide.join(found, F.col(names[k]).eqNullSafe(F.col("_key")) & (F.xxhash64(F.col(names[at]).cast("string")) == F.col("_hash")), "left")
    body = F.col(names[at])
    clean = F.when(F.col("_cut").isNotNull(), F.array_join(F.transform(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda c, i: _masked(c, i * CHUNK, F.col("_cut"), mask)), "")).otherwise(body)
    # apart from the renaming: within one select a lambda would take a column of the same new name for its own
    masked = joined.withColumns({"_clean": clean, "_hit": F.col("_cut").isNotNull()})
    out = [F.col(n) for n in names]
    out[at] = F.col("_clean")
    if "n_chars" in docs.columns:
        i = docs.columns.index("n_chars")
        out[i] = F.when(F.col("_hit"), F.length("_clean")).otherwise(F.col(names[i])).cast(docs.schema[i].dataType)
    return masked.select(*out).toDF(*docs.columns)
