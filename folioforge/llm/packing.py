"""Sequence packing by minimum bin slack.

Documents become ids with an end id.  A document is cut into whole windows and a rest shorter than
the window.  What the rests' packing needs to know of the corpus is how many rests there are of each
length: a histogram of ``window`` counts, whatever the corpus' size.  On it, a window is filled at a
time: a bitset subset-sum over the remaining lengths (bit s of a big integer: sum s can be reached)
finds the fill closest to the capacity, and walking the layers back gives how many rests of each
length make it up.  That pattern is laid down as often as the remaining counts allow, which at least
halves what remains of some length, so the plan's size goes with ``window`` and the logarithm of the
number of rests.

The n-th rest of a length then finds its sequence and offset by a binary search in the plan.  Its n
is its number within its task, counted as the task writes it, plus the counts of the tasks before.

Each sequence takes up ``window`` places, but for one whose length is a power of two, which needs no
padding.  Defined cases: a null or empty text is its end id alone; repeated ids or rows are
documents of their own; an empty table gives no piece; further columns are not read; a text of any
length is cut into as many windows as it fills.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_null, pieces, stage
from .memo_bpe import shared

WINDOW = 1024
#: The most rows of (task, length, count) that are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1 << 20


def fill(lengths: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """How many of each length make up the sum closest below ``capacity``; longer rests first."""
    mask = (1 << (capacity + 1)) - 1
    reach, layers = 1, []
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        layers.append(reach)
        size, left, unit = lengths[i], min(counts[i], capacity // lengths[i]), 1
        while left:  # counts in powers of two: 1, 2, 4 ... and what is left
            take = min(unit, left)
            reach |= (reach << (size * take)) & mask
            left -= take
            unit *= 2
        if reach >> capacity:
            break
    total, used = reach.bit_length() - 1, {}
    for k in range(len(layers) - 1, -1, -1):
        size, n = lengths[order[k]], 0
        while not layers[k] >> total & 1:
            total -= size
            n += 1
        if n:
            used[size] = n
    return used


def plan(histogram: dict[int, int], capacity: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: count}) for each pattern, in the order of their sequences."""
    left = {k: v for k, v in sorted(histogram.items(), reverse=True) if v > 0}
    out: list[tuple[int, dict[int, int]]] = []
    while left:
        first = next(iter(left))  # minimum bin slack holds the largest rest fixed in the bin
        others = dict(left)
        others[first] -= 1
        lengths = [k for k, v in others.items() if v and k <= capacity - first]
        used = fill(lengths, [others[k] for k in lengths], capacity - first) if lengths else {}
        used[first] = used.get(first, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        out.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


class Lookup:
    """(length, number) -> (sequence, offset), from a plan."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]) -> None:
        seq, given, rows = 0, {}, []
        for times, used in patterns:
            offset = 0
            for length, n in used.items():
                start = given.get(length, 0)
                rows.append((length, start, n, seq, offset))
                given[length] = start + n * times
                offset += length * n
            seq += times
        rows.sort()
        self.length, self.start, self.n, self.seq, self.offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
        self.first = {k: i for i, k in reversed(list(enumerate(self.length.tolist())))}
        self.sequences = seq

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            rows = np.flatnonzero(length == k)
            a = self.first[k]
            b = a + int(np.searchsorted(self.length[a:], k, "right"))
            at = a + np.searchsorted(self.start[a:b], number[rows], "right") - 1
            behind = number[rows] - self.start[at]
            seq[rows] = self.seq[at] + behind // self.n[at]
            offset[rows] = self.offset[at] + behind % self.n[at] * k
        return seq, offset


def _cutter(encoder: tuple, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), shared(*encoder), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(window + 1, np.int64)
        names = ["key", "start", "length", "ids", "doc_tokens", "part", "number"]
        for batch in pieces(batches, most=1 << 20):
            cols: list[list] = [[] for _ in range(5)]
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                ids = enc.encode(text) + end
                total = len(ids) >> 2
                for a in range(0, total, window):
                    n = min(window, total - a)
                    for c, v in zip(cols, (key, a, n, ids[4 * a : 4 * (a + n)], total)):
                        c.append(v)
            length = np.array(cols[2], np.int64)
            number = np.zeros(len(length), np.int64)
            by = np.argsort(length, kind="stable")
            kinds, first, many = np.unique(length[by], return_index=True, return_counts=True)
            number[by] = np.arange(len(by)) - np.repeat(first, many) + np.repeat(seen[kinds], many)
            seen[kinds] += many
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))), pa.array(np.full(len(length), part), pa.int64()), pa.array(number, pa.int64())], names)

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 0, key: str = "doc_id", text: str = "text", memo: int = 600_000, special_as_text: bool = False) -> DataFrame:
    """Per piece: key, start, length, ids (little-endian uint32 bytes), doc_tokens, sequence_id, offset."""
    src = no_null(docs, key, text)
    cut = stage(src.mapInArrow(_cutter((uuid.uuid4().hex, vocabulary, memo, 4, special_as_text), end_id, window), "key bigint, start bigint, length bigint, ids binary, doc_tokens bigint, part bigint, number bigint"), "pieces")
    counts = stage(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    whole = histogram.pop(window, 0)
    lookup = Lookup(plan(histogram, window))
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        length, number = length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        rest = length < window
        seq, offset = np.where(rest, 0, number), np.zeros(len(length), np.int64)
        s, o = lookup(length[rest], number[rest])
        seq[rest], offset[rest] = whole + s, o
        return pa.StructArray.from_arrays([pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], ["sequence_id", "offset"])

    placed = cut.join(base, ["length", "part"]).withColumn("at", place("length", F.col("number") + F.col("before")))
    return placed.select("key", "start", "length", "ids", "doc_tokens", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The padded sequences: sequence_id, ids (little-endian uint32 bytes), n_tokens before padding.

    A sequence has at most ``window`` ids, so what is gathered for it is bounded."""
    got = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    body = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    n = F.col("n_tokens")
    pad = F.when(F.bit_count(n) == 1, 0).otherwise(window - n)
    one = F.lit(int(pad_id).to_bytes(4, "little")).cast("binary")
    return got.select("sequence_id", F.concat(body, F.aggregate(F.array_repeat(one, pad.cast("int")), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))).alias("ids"), "n_tokens")
