"""Benchmark decontamination with suffix arrays over the training text.

Every task is a shard: it turns its documents into word ids, builds a suffix array over them and
binary-searches all suffixes of the benchmark's items in it, one word deeper at a time, which gives
each suffix its longest verbatim match and the matches' places.  Places where a suffix matches a
whole window mark the window's words as hit.

Only words of the benchmark can match, and only runs of at least the shortest window's length can
hold a window, so the array leaves the other positions out; nothing that could match is lost.

What is held is bounded by a batch of texts and a block of the benchmark, whatever repeats in them: equal
windows are one range of the array, ranges of one width are disjoint, and the longest matches are the
innermost of nested ranges, so no pair of a place and an item is ever made but those in the result.

Defined cases: a null or empty text, or one without words, has n_words 0, no hits and is clean.  A
null or wordless item has no window; one without an id hits words but is not listed.  Repeated items with one
id count once; repeated documents are judged each on its own.  An empty benchmark leaves every document
clean, an empty table gives an empty result.  Further columns of either table are not read.  Texts are
processed whole.  Ids are long integers.  Words are compared by 64-bit hashes.

The benchmark is a stated query set: its words are broadcast in blocks of at most ``BLOCK_CHARS`` characters,
and one pass over the documents tries all of them on each batch, one block in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, no_null, pieces, utf8, word_hashes, word_spans

WINDOW = 13
BLOCK_CHARS = 8 << 20
#: Entries of (document, item) that are spread out at once.
SPREAD = 1 << 18


class Items:
    """The suffixes of a block of items, as word ids (1 and up; 0 matches nothing)."""

    def __init__(self, rows: list[tuple], window: int) -> None:
        text = pa.array([t for _, t in rows], pa.string())
        data, off = utf8(text)
        data = LOWER[data]
        starts, ends, first = word_spans(data, off, ALNUM)
        hashes = word_hashes(data, starts, ends)
        self.vocabulary = np.unique(hashes)
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        n = np.diff(first)
        self.key = np.array([k or 0 for k, _ in rows], np.int64)
        self.named = np.array([k is not None for k, _ in rows], bool)
        self.item = np.repeat(np.arange(len(rows)), n)
        self.words = np.searchsorted(self.vocabulary, hashes) + 1
        self.rest = first[1:][self.item] - np.arange(len(self.words))  # words from here to the item's end
        self.width = np.minimum(n, window)[self.item]
        self.shortest = int(self.width.min()) if len(self.width) else 0
        self.longest = int(n.max()) if len(n) else 0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.gate[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            ok = self.vocabulary[at] == hashes[maybe]
            out[maybe[ok]] = at[ok] + 1
        return out


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``s`` in the order of their suffixes' first ``depth`` words, by prefix doubling."""
    rank, k = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth and len(s):
        after = np.full(len(s), -1, np.int64)
        after[:-k or None] = rank[k:] if k < len(s) else -1
        if k >= len(s):
            break
        key = rank * (int(rank.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank[order] = new
        k *= 2
        if new[-1] == len(s) - 1:
            break
    return order


def search(s: np.ndarray, order: np.ndarray, items: Items):
    """For every suffix of the items: the places range [lo, hi) in ``order`` that match its window, and the
    length, range of its longest match.  ``s`` ends in a 0 and holds 0 between texts."""
    n = len(items.words)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    best_lo, best_hi, best = lo.copy(), lo.copy(), np.zeros(n, np.int64)
    win_lo, win_hi = lo.copy(), lo.copy()
    active = np.arange(n)
    padded = np.concatenate((s, np.zeros(items.longest + 1, s.dtype)))

    def bound(a, b, want, d, right):
        a, b = a.copy(), b.copy()
        while len(a) and (open_ := a < b).any():
            mid = (a + b) >> 1
            got = padded[order[np.minimum(mid, len(order) - 1)] + d]
            up = open_ & ((got <= want) if right else (got < want))
            a = np.where(up, mid + 1, a)
            b = np.where(open_ & ~up, mid, b)
        return a

    d = 0
    while len(active) and len(order):
        active = active[items.rest[active] > d]
        want = items.words[active + d]
        a = bound(lo[active], hi[active], want, d, False)
        b = bound(a, hi[active], want, d, True)
        keep = a < b
        active, a, b = active[keep], a[keep], b[keep]
        lo[active], hi[active] = a, b
        d += 1
        best[active], best_lo[active], best_hi[active] = d, a, b
        full = items.width[active] == d
        win_lo[active[full]], win_hi[active[full]] = a[full], b[full]
    return win_lo, win_hi, best, best_lo, best_hi


def _flat(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    size = hi - lo
    return np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if size.sum() else np.zeros(0, np.int64)


def innermost(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int]]:
    """Of ranges that are nested or disjoint, in the order of starts and, of one start, of falling ends: disjoint
    (start, end, number of the innermost range) in order."""
    out, held, at = [], [], 0

    def upto(end: int) -> None:
        nonlocal at
        if held and at < end:
            out.append((at, end, held[-1]))
        at = max(at, end)

    bounds = list(zip(lo.tolist(), hi.tolist()))
    for i, (a, _) in enumerate(bounds):
        while held and bounds[held[-1]][1] <= a:
            upto(bounds[held[-1]][1])
            held.pop()
        upto(a)
        held.append(i)
    while held:
        upto(bounds[held[-1]][1])
        held.pop()
    return out


def _lists(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of the rows' lists, entries in the order of rows."""
    return np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)


_NONE = np.zeros(0, np.int64)


class Shard:
    """A batch of texts: their words, and what the blocks of the benchmark found in them."""

    def __init__(self, array: pa.Array) -> None:
        data, off = utf8(array)
        data = LOWER[data]
        starts, ends, self.first = word_spans(data, off, ALNUM)
        self.hashes = word_hashes(data, starts, ends)
        self.n_words = np.diff(self.first)
        self.row = np.repeat(np.arange(len(array)), self.n_words)
        self.hit = np.zeros(len(self.hashes), bool)
        #: Of each block: (document, window) pairs in the order of documents, and each window's items as lists.
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        #: Of each text: length, item (-1: none), its id, places in item and text of the longest match.
        self.longest = np.zeros((len(array), 5), np.int64)
        self.longest[:, 1] = -1

    def match(self, items: Items) -> None:
        if not items.shortest or not len(self.hashes):
            return
        row, ids = self.row, items.ids(self.hashes)
        known = ids > 0
        cut = np.ones(len(ids), bool)
        cut[1:] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
        run = np.cumsum(cut) - 1
        kept = np.flatnonzero(known & (np.bincount(run) >= items.shortest)[run])
        if not len(kept):
            return
        gap = np.concatenate(([0], np.cumsum(run[kept][1:] != run[kept][:-1])))
        s = np.zeros(len(kept) + int(gap[-1]) + 1, np.int64)
        place = np.arange(len(kept)) + gap
        s[place] = ids[kept]
        word_at = np.full(len(s), -1, np.int64)
        word_at[place] = kept
        order = suffix_array(s, items.longest)
        order = order[s[order] > 0]
        win_lo, win_hi, best, best_lo, best_hi = search(s, order, items)
        word_at = word_at[order]
        self._windows(items, word_at, win_lo, win_hi)
        self._longest(items, word_at, best, best_lo, best_hi)

    def _windows(self, items: Items, word_at: np.ndarray, win_lo: np.ndarray, win_hi: np.ndarray) -> None:
        matched = np.flatnonzero(win_hi > win_lo)
        rows, windows, lists, many, before = [], [], [], [], 0
        cover = np.zeros(len(self.hit) + 1, np.int32)
        for width in np.unique(items.width[matched]).tolist():
            q = matched[items.width[matched] == width]
            lo, first, window = np.unique(win_lo[q], return_index=True, return_inverse=True)  # equal windows have one range
            hi = win_hi[q[first]]
            at = word_at[_flat(lo, hi)]  # ranges of one width are disjoint
            cover[at] += 1
            cover[at + width] -= 1
            pair = np.unique(self.row[at] * len(lo) + np.repeat(np.arange(len(lo)), hi - lo))
            rows.append(pair // len(lo))
            windows.append(pair % len(lo) + before)
            named = items.named[items.item[q]]
            of = np.unique(np.stack([window[named] + before, items.key[items.item[q][named]]]), axis=1)
            lists.append(of[1])
            many.append(np.bincount(of[0] - before, minlength=len(lo)))
            before += len(lo)
        self.hit |= np.cumsum(cover[:-1]) > 0
        if rows:
            row, window = np.concatenate(rows), np.concatenate(windows)
            by = np.argsort(row, kind="stable")
            self.found.append((row[by], window[by], np.concatenate(([0], np.cumsum(np.concatenate(many)))), np.concatenate(lists)))

    def _longest(self, items: Items, word_at: np.ndarray, best: np.ndarray, best_lo: np.ndarray, best_hi: np.ndarray) -> None:
        use = np.flatnonzero(best >= items.width)
        if not len(use):
            return
        use = use[np.lexsort((use, -best[use], -best_hi[use], best_lo[use]))]
        lo, hi = best_lo[use], best_hi[use]
        new = np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        use, lo, hi = use[new], lo[new], hi[new]
        a, b, i = np.array(innermost(lo, hi), np.int64).T
        q, at = np.repeat(use[i], b - a), word_at[_flat(a, b)]
        by = np.lexsort((q, at, -best[q], self.row[at]))
        q, at = q[by], at[by]
        one = np.concatenate(([True], self.row[at][1:] != self.row[at][:-1]))
        q, at = q[one], at[one]
        item, r = items.item[q], self.row[at]
        got = np.stack([best[q], np.where(items.named[item], item, -2), items.key[item], q - np.searchsorted(items.item, item), at - self.first[r]], 1)
        more = got[:, 0] > self.longest[r, 0]
        self.longest[r[more]] = got[more]

    def batches(self) -> Iterator[tuple[int, int, pa.Array]]:
        """(from, to, the result of these rows), in so many rows that what is spread out stays bounded; one row at least."""
        size = np.zeros(len(self.n_words), np.int64)
        for row, window, ends, _ in self.found:
            size += np.bincount(row, ends[window + 1] - ends[window], len(size)).astype(np.int64)
        total, a = np.cumsum(size), 0
        begin = np.flatnonzero(self.hit & ~np.concatenate(([False], self.hit[:-1] & (self.row[1:] == self.row[:-1]))))
        finish = np.flatnonzero(self.hit & ~np.concatenate((self.hit[1:] & (self.row[1:] == self.row[:-1]), [False]))) + 1
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(total, (int(total[a - 1]) if a else 0) + SPREAD, "right")))
            pairs = [np.zeros((2, 0), np.int64)]
            for row, window, ends, keys in self.found:
                x, y = np.searchsorted(row, (a, b))
                w = window[x:y]
                n = ends[w + 1] - ends[w]
                pairs.append(np.stack([np.repeat(row[x:y] - a, n), keys[_flat(ends[w], ends[w + 1])]]))
            pair = np.concatenate(pairs, 1)
            pair = pair[:, np.lexsort((pair[1], pair[0]))]
            pair = pair[:, np.concatenate(([True], (pair[:, 1:] != pair[:, :-1]).any(0)))[: pair.shape[1]]]
            x, y = np.searchsorted(self.row[begin], (a, b))
            of = self.row[begin[x:y]]
            span = pa.StructArray.from_arrays([pa.array(begin[x:y] - self.first[of]), pa.array(finish[x:y] - self.first[of])], ["start", "end"])
            n, item, key, item_word, doc_word = self.longest[a:b].T
            longest = pa.StructArray.from_arrays([pa.array(key, mask=item < 0), *(pa.array(v) for v in (item_word, doc_word, n))], ["item_id", "item_word", "doc_word", "n_words"], mask=pa.array(n == 0))
            yield a, b, pa.StructArray.from_arrays(
                [pa.array(self.n_words[a:b]), pa.ListArray.from_arrays(pa.array(_lists(of - a, b - a)), span), pa.ListArray.from_arrays(pa.array(_lists(pair[0], b - a)), pa.array(pair[1])), longest],
                ["n_words", "spans", "items", "longest"],
            )
            a = b


FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<bigint>,longest:struct<item_id:bigint,item_word:bigint,doc_word:bigint,n_words:bigint>>"


def _matcher(blocks_: list):
    """Appends ``found``; the other columns ride along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, most=8 << 20):
            shard = Shard(part.column("text"))
            for block in blocks_:
                shard.match(block.value)
                if len(blocks_) > 1:  # a worker keeps no block but the one that it tries
                    block.__dict__.pop("_value", None)
            for a, b, found in shard.batches():
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in part.columns), found], [*part.schema.names, "found"])

    return run


def blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``block_chars`` characters, one item at least, streamed by the driver."""
    out, size = [], 0
    for key, value in no_null(benchmark, item, text).toLocalIterator():
        if out and size + len(value) > block_chars:
            yield out
            out, size = [], 0
        out.append((key, value))
        size += len(value)
    yield out


def _annotated(src: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``src`` with ``found``; one pass, one Python stage, no shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields) + f", found {FOUND}"
    send = src.sparkSession.sparkContext.broadcast
    return src.mapInArrow(_matcher([send(Items(rows, window)) for rows in blocks(benchmark, item, item_text, block_chars)]), schema)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """Per document row: key, n_words, spans (of hit words, disjoint, in order), items (ids found,
    distinct, ascending), longest (the longest verbatim match that holds a window, with its places)."""
    return _annotated(no_null(docs, key, text), benchmark, **more).select("key", "found.*")


def n_hit(spans: str = "spans") -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])


def is_contaminated(n_words: str = "n_words", spans: str = "spans") -> F.Column:
    """At least one word in twenty is hit."""
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """``docs`` without the contaminated documents; all columns ride along with the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names)
    wide = wide.withColumn("text", F.coalesce(F.col(names[docs.columns.index(text)]), F.lit("")))
    clean = _annotated(wide, benchmark, **more).where(~is_contaminated("found.n_words", "found.spans"))
    return clean.select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])
