"""Quality rules: a decision list learned by sequential covering.

Per document there are statistics of its words, lines and characters.  From labelled documents the
learner grows a conjunction of thresholds on ratios of them that covers low quality (by information
gain), prunes its tail on documents held out, keeps it if it is precise there, removes what it covers
and goes on; the list is emitted as an ordered Spark conditional expression over the statistics.

Learning takes at most ``MOST_LABELLED`` labelled documents (those of the lowest hashed ids, one row of each
id); the statistics and the verdict cover every document.  The learner's size is bounded by ``CUTS``
thresholds tried for a ratio, ``LONGEST`` conditions of a rule and ``MOST_RULES`` rules: a list that a reader
can check.  It mostly ends earlier, at the first rule that is not precise.

Defined cases: a null or wordless text has zero statistics and fails the base rule; without labels,
or with labels of one kind, the list is empty and the base rule alone decides; several labels of one
id count as low if one of them is; of several documents with a labelled id the one with the least ratios (in
the order of RATIOS) is learned from; null labels are not used; an empty table gives an empty result;
further columns are not read by :func:`statistics` and kept by :func:`filter_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import INK, no_null, odd, mix, pieces, utf8, word_hashes, word_spans

REPEAT_WINDOW = 8
MOST_LABELLED = 20_000
CUTS, LONGEST, MOST_RULES = 64, 4, 16
SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def _distinct_keys(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One 64-bit key for each (value, row)."""
    return mix(value ^ mix(row.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The statistics in the order of STATS, each for all texts."""
    data, off = utf8(texts)
    starts, ends, first = word_spans(data, off, INK)
    rows, n_words = len(texts), np.diff(first)
    ink = INK[data] & ((data & 0xC0) != 0x80)
    h = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(rows), n_words)
    repeat, distinct = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if len(h):
        distinct = np.bincount(row[np.unique(_distinct_keys(h, row), return_index=True)[1]], minlength=rows)
    w = REPEAT_WINDOW
    if len(h) >= w:
        at = np.flatnonzero(row[: len(h) - w + 1] == row[w - 1 :])
        if len(at):
            m = odd(w)
            value = sum(h[at + k] * m[k] for k in range(w))
            key = _distinct_keys(value, row[at])
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(h) + 1, np.int64)
            cover[at[twice]] += 1
            cover[at[twice] + w] -= 1
            repeat = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)
    dup, lines = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        inked = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        lines[i], dup[i] = len(inked), len(inked) - len(set(inked))
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    return [n_words, _per_row(ink, off), _per_row(SYMBOLS[data], off), dup, repeat, lines, _per_row(upper, off), _per_row(digit, off), _per_row(mark, off), distinct]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the statistics to whatever columns there are."""
    for part in pieces(batches):
        stats = [pa.array(x, pa.int64()) for x in measure(part.column("text"))]
        yield pa.RecordBatch.from_arrays([*part.columns, *stats], [*part.schema.names, *STATS])


def _with_stats(src: DataFrame) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(_measured, schema + "".join(f", {s} bigint" for s in STATS))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the statistics of each row's whole text."""
    return _with_stats(no_null(docs, key, text)).drop("text")


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: The ratios that rules set thresholds on: a name, and numerator and denominator among the statistics.
RATIOS = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_char": ("n_marks", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "repeat_per_word": ("n_repeat_words", "n_words"),
    "distinct_per_word": ("n_distinct", "n_words"),
    "dup_per_line": ("n_dup_lines", "n_lines"),
    "words": ("n_words", None),
}


def ratio(name: str) -> F.Column:
    top, under = RATIOS[name]
    return F.col(top).cast("double") if under is None else F.col(top) / F.greatest(F.col(under), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> F.Column:
        return ratio(self.feature) >= self.threshold if self.above else ratio(self.feature) < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        col = x[:, list(RATIOS).index(c.feature)]
        out &= col >= c.threshold if c.above else col < c.threshold
    return out


def _grow(x: np.ndarray, low: np.ndarray, cuts: int = CUTS, longest: int = LONGEST) -> Rule:
    rule: tuple[Condition, ...] = ()
    inside = np.ones(len(x), bool)
    while len(rule) < longest:
        p, n = int(low[inside].sum()), int((~low[inside]).sum())
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for j, name in enumerate(RATIOS):
            col = x[inside, j]
            values = np.unique(np.concatenate((np.quantile(col, np.linspace(0, 1, cuts)), np.quantile(col[low[inside]], np.linspace(0, 1, cuts)))))
            for t in (values[1:] + values[:-1]) / 2:
                side = col >= t
                for above in (True, False):
                    got = side if above else ~side
                    q = int(low[inside][got].sum())
                    if q and q < p + n:
                        gain = q * (np.log2(q / int(got.sum())) - before)
                        if gain > best[0]:
                            best = (gain, Condition(name, above, float(t)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside = covers(rule, x)
    return rule


def _worth(rule: Rule, x: np.ndarray, low: np.ndarray) -> float:
    got = covers(rule, x)
    p, n = int(low[got].sum()), int((~low[got]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _tighten(rule: Rule, x: np.ndarray, low: np.ndarray, share: float = 0.02) -> Rule:
    """Thresholds moved to where all but a small share of the low documents that the rule covers still pass:
    between the kinds of documents, it is the clean ones that get the room."""
    inside = x[covers(rule, x) & low]
    if not len(inside):
        return rule
    out = []
    for c in rule:
        col = inside[:, list(RATIOS).index(c.feature)]
        near = float(np.quantile(col, share, method="lower")) if c.above else float(np.quantile(col, 1 - share, method="higher")) + 1e-9
        out.append(Condition(c.feature, c.above, max(near, c.threshold) if c.above else min(near, c.threshold)))
    return tuple(dict.fromkeys(out))


def learn(x: np.ndarray, low: np.ndarray, precision: float = 0.95, least: int = 3, most_rules: int = MOST_RULES) -> list[Rule]:
    """An ordered list of rules for low quality; x has the ratios in columns."""
    rules: list[Rule] = []
    fold = np.arange(len(x)) % 3 == 2  # a third prunes and judges what the others grow
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (low & left & ~fold).sum() >= least:
        g, h = left & ~fold, left & fold
        rule = _grow(x[g], low[g])
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, x[h], low[h]))
        rule = _tighten(rule, x[g], low[g])
        got = covers(rule, x) & h
        p, all_ = int(low[got].sum()), int(got.sum())
        if p < min(least, max(1, int((low & h).sum()))) or p < precision * all_:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> F.Column:
    """False where a rule fires, in the list's order; true else."""
    out = None
    for rule in rules:
        fires = rule[0].column()
        for c in rule[1:]:
            fires &= c.column()
        out = F.when(fires, F.lit(False)) if out is None else out.when(fires, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> list[Rule]:
    """Rules from at most ``most`` labelled documents; the sample and its statistics alone reach the driver."""
    given = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y")).dropna().groupBy("key").agg(F.min("y").alias("y"))
    # all, or those with hashed ids up to the share that gives about ``most``; so no task passes on more than its share
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(given.count(), 1)))
    sample = given.where(share).orderBy(F.xxhash64("key"), "key").limit(most)
    rows = no_null(docs, key, text).join(F.broadcast(sample), "key")
    one = _with_stats(rows).groupBy("key", "y").agg(F.min(F.struct(*[ratio(r).alias(r) for r in RATIOS])).alias("r"))  # at most ``most`` rows
    got = one.select("key", "y", "r.*").toPandas().sort_values("key").to_numpy(float)
    if not len(got):
        return []
    got = got[np.random.default_rng(0).permutation(len(got))]
    return learn(got[:, 2:], got[:, 1] == 0)


def kept(rules: list[Rule]) -> F.Column:
    return ~base_failed() & verdict(rules)


def filter_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``; one pass after learning, no shuffle of texts."""
    rules = learn_rules(docs, labels, key, text, **more)
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names).withColumn("text", F.coalesce(F.col(names[docs.columns.index(text)]), F.lit("")))
    return _with_stats(wide).where(kept(rules)).select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])
