"""Language-model scoring with a hashed, class-factored maximum-entropy model.

A word belongs to one of 16 x 16 classes by its letters, and within its class to one of 16 x 16 leaves by
its hash.  The model is

    p(word | context) = p(c1 | context) p(c2 | c1, context) p(c3 | c1, c2, context) p(c4 | c1 .. c3, context) p(word | leaf)

All class and leaf factors are softmaxes over hashed features of the context (the word before, the two
classes before, and two skips: the word two before and the class three before) added to the corpus' own
log frequencies, so that a model without weights is the unigram model.  Each factor has a table of weights
of its own, whose rows grow with the square root of the counted tokens (:func:`table_rows`), up to what a task can
hold; a row is a full mix of a feature and the factors before.  What is left to the corpus' counts alone is the word in its
leaf, one of 65,536, with half a count for every word and for all unseen words of a leaf.

Training is one pass over all training text in ``ROUNDS`` rounds.  In a round each task takes about
``TASK_TOKENS`` tokens (128 for each row of a table, if that is more) or more and makes adaptive gradient
steps on them from the current weights; the tasks' changes are summed by blocks of weights, in a tree where
there are many, and the sums alone (as large as the weights) reach the driver.

Counts cover all training text and are kept as a table.  Words among the ``HEAD`` most frequent are
looked up in a broadcast array of that bound; the others are joined by word.  A word is represented
by a 64-bit hash of its bytes.

Defined cases: a null or empty text is the end token alone; a null id is training text; repeated rows
count and are scored each on its own; without training text every word is unknown and both scores
are those of an empty model; an empty table gives an empty result; further columns are not read;
texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import INK, LOWER, mix, no_null, pieces, stage, utf8, word_hashes, word_spans

C = 16
DEPTH = 4
LEAVES = C**DEPTH
#: The least and the most rows of a table; the most is what a task can hold (four tables and their state, 128 MB).
ROWS = 1 << 14
MOST_ROWS = 1 << 18
HEAD = 1 << 18
ROUNDS = 2
RATE = 0.1
STEP = 1 << 14
END = np.uint64(0x9E3779B97F4A7C15)
#: Weights in a message.
BLOCK = 1 << 16
#: From so many messages a block on, they are merged in a tree.
FAN = 16
TASK_TOKENS = 2_000_000
#: What squared gradients sum up to, on average, when a later round begins.
BEGUN = 16.0


def table_rows(total: int) -> int:
    """Rows of each factor's table for so many counted tokens: a power of two, at least twice their square root, up to
    ``MOST_ROWS`` (from 16 G tokens on)."""
    return min(max(ROWS, 1 << int(np.ceil(np.log2(2 * np.sqrt(max(total, 1)))))), MOST_ROWS)


def held_out(key: str = "key") -> Column:
    """crc32 of the id as text leaves 1 divided by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and leaf of every token, an end after each text's words, and the offsets of the texts in them."""
    data, off = utf8(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, INK)
    n, rows = len(starts), len(texts)
    at = np.arange(n) + np.repeat(np.arange(rows), np.diff(first))
    h = np.full(n + rows, END)
    cls = np.zeros(n + rows, np.int64)
    h[at] = word_hashes(data, starts, ends)
    if n:
        a, b = data[starts].astype(np.uint64), data[np.minimum(starts + 1, ends - 1)].astype(np.uint64)
        y, z = data[np.maximum(ends - 2, starts)].astype(np.uint64), data[ends - 1].astype(np.uint64)
        c1 = mix((y << np.uint64(8) | z) + np.uint64(77)) & np.uint64(C - 1)
        c2 = mix((a << np.uint64(16) | b << np.uint64(8) | np.minimum(ends - starts, 12).astype(np.uint64)) + np.uint64(99)) & np.uint64(C - 1)
        cls[at] = ((c1 * np.uint64(C) + c2) * np.uint64(LEAVES // C**2) + h[at] % np.uint64(LEAVES // C**2)).astype(np.int64)
    return h, cls, first + np.arange(rows + 1)


def _before(x: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """What stands k tokens before each token, 0 where that is before its text."""
    out = np.zeros(len(x), np.uint64)
    out[k:] = x[:-k] if len(x) > k else out[k:]
    for j in range(k):
        at = off[:-1] + j
        out[at[at < off[1:]]] = 0
    return out


def features(h: np.ndarray, cls: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashes of each token's features: the word before, the two classes before, and two skips (the word two
    before, the class three before)."""
    u = np.uint64
    c = (cls // (LEAVES // C**2)).astype(np.uint64) + u(1)
    pair = _before(c, off, 1) * u(0xD6E8FEB86659FD93) + _before(c, off, 2) * u(0xCA5A826395121157)
    kinds = (_before(h, off, 1) + u(1), pair + u(2), _before(h, off, 2) + u(3), _before(c, off, 3) * u(0x9FB21C651E98DF25) + u(4))
    return np.stack([mix(k) for k in kinds])


#: The features of words, which alone the leaf's factors have; the classes before tell little there.
WORDS = [0, 2]
_ONES = np.ones(C, np.float32)


def _logits(w: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The features' weights and the prior, bounded so that no exponential overflows or vanishes."""
    x = w.take(rows[0], 0)
    for r in rows[1:]:
        x += w.take(r, 0)
    x += prior
    return np.clip(x, -80, 80, out=x)


def factor_rows(f: np.ndarray, before: np.ndarray, level: int, rows: int) -> np.ndarray:
    """Rows of a factor's weights, which depend on the features' hashes and on all factors before it."""
    u = np.uint64
    if level:
        f = mix(f + (before.astype(u) + u(1)) * u(0x9FB21C651E98DF25) + u(level))
    return (f & u(rows - 1)).astype(np.int64)


class Model:
    """Log frequencies of each factor's outcomes (a row of C for each outcome of the factors before) and its weights."""

    def __init__(self, *priors: np.ndarray, rows: int = ROWS, w: list[np.ndarray] | None = None) -> None:
        self.priors = [np.asarray(p).reshape(-1, C).astype(np.float32) for p in priors]
        self.w = [np.zeros((rows, C), np.float32) for _ in priors] if w is None else w

    w1 = property(lambda self: self.w[0], lambda self, x: self.w.__setitem__(0, x))
    w2 = property(lambda self: self.w[1], lambda self, x: self.w.__setitem__(1, x))

    def factors(self, f: np.ndarray, cls: np.ndarray) -> Iterator[tuple]:
        """Of each factor: its level, rows, prior and outcome."""
        f = f.astype(np.uint64, copy=False)
        for level, (w, prior) in enumerate(zip(self.w, self.priors)):
            before, c = np.divmod(cls // C ** (len(self.w) - 1 - level), C)
            yield level, factor_rows(f if level < 2 else f[WORDS], before, level, len(w)), prior.take(before, 0) if level else prior[0], c

    def score(self, f: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural log of the factors' product for each token."""
        out = np.zeros(f.shape[1])
        for at in range(0, f.shape[1], STEP):
            part = cls[at : at + STEP]
            i = np.arange(len(part))
            for level, g, prior, c in self.factors(f[:, at : at + STEP], part):
                x = _logits(self.w[level], g, prior)
                out[at : at + STEP] += x[i, c] - np.log(np.exp(x) @ _ONES)
        return out

    def train(self, f: np.ndarray, cls: np.ndarray, state: list[np.ndarray]) -> None:
        """Adaptive gradient steps on batches of tokens; state: the sums of squared gradients."""
        for at in range(0, f.shape[1], STEP):
            for level, g, prior, c in self.factors(f[:, at : at + STEP], cls[at : at + STEP]):
                w, s = self.w[level], state[level]
                p = _logits(w, g, prior)
                np.exp(p, out=p)
                p /= (p @ _ONES)[:, None]
                p[np.arange(len(c)), c] -= 1
                # a row's gradient is the sum over all features of the batch that share it, one outcome at a time
                rows, columns, touched = np.concatenate(g), p.T.astype(float), slice(None)
                if len(rows) < len(w):  # of a large table, the rows that the batch touches alone
                    touched, rows = np.unique(rows, return_inverse=True)
                many = len(w) if isinstance(touched, slice) else len(touched)
                sums = np.empty((C, many), np.float32)
                for k in range(C):
                    sums[k] = np.bincount(rows, np.tile(columns[k], len(g)), many)
                grad = np.ascontiguousarray(sums.T)
                s[touched] += grad * grad
                grad *= RATE
                grad /= np.sqrt(s[touched] + 1.0)
                w[touched] -= grad


COUNTS = "h bigint, cls int, c bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's tokens, merged up to a bound before they are passed on."""
    held: list[tuple] = []
    size = 0

    def merged() -> tuple:
        h, cls, c = (np.concatenate(x) for x in zip(*held))
        value, first, at = np.unique(h, return_index=True, return_inverse=True)
        return value, cls[first], np.bincount(at, c).astype(np.int64)

    def out(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["h", "cls", "c"])

    for part in pieces(batches, most=4 << 20):
        h, cls, _ = tokens(part.column("text"))
        value, first, many = np.unique(h, return_index=True, return_counts=True)
        held.append((value, cls[first], many))
        size += len(value)
        if size > 1 << 21:
            held = [merged()]
            size = len(held[0][0])
            if size > 1 << 20:
                yield out(held[0])
                held, size = [], 0
    if held:
        yield out(merged())


class Corpus:
    """What the counts say: total, distinct, by leaf; the head's hashes and counts."""

    def __init__(self, counts: DataFrame) -> None:
        n, v = np.zeros(LEAVES), np.zeros(LEAVES)
        by = counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()  # at most LEAVES rows
        n[by.column("cls").to_numpy()], v[by.column("cls").to_numpy()] = by.column("n").to_numpy(), by.column("v").to_numpy()
        self.total, self.distinct = int(n.sum()), int(v.sum())
        self.rows = table_rows(self.total)
        self.norm = np.log10(n + 0.5 * (v + 1))
        mass = n + 0.5 * (v + 1)
        sums = [mass.reshape(C ** (k + 1), -1).sum(1).reshape(-1, C) for k in range(DEPTH)]
        self.priors = [np.log(x / x.sum(1, keepdims=True)) for x in sums]
        # the count from which words are in the head, from a histogram by eighths of a power of two
        level = F.floor(F.log2("c") * 8).cast("int")
        many, self.level = 0, None
        for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # at most 8 * 63 rows
            many += r["n"]
            if many > HEAD:
                break
            self.level = r["level"]
        self.head_rows = None if self.level is None else level >= self.level
        self.head = np.zeros(0, np.uint64)
        self.head_c = np.zeros(0, np.int64)
        if self.head_rows is not None:
            head = counts.where(self.head_rows).select("h", "c").toArrow()  # at most HEAD rows
            h, c = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy()
            order = np.argsort(h)
            self.head, self.head_c = h[order], c[order]

    def tail(self, counts: DataFrame) -> DataFrame:
        return counts if self.head_rows is None else counts.where(~self.head_rows)


MESSAGE = "block int, part bigint, seen bigint, sums binary"


def _merged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of changes, and of the tokens behind them, by block."""
    sums: dict[int, list] = {}
    for batch in rows:
        for b, n, x in zip(*(batch.column(c).to_pylist() for c in ("block", "seen", "sums"))):
            s = sums.setdefault(b, [0, 0.0])
            s[0] += n
            s[1] = s[1] + np.frombuffer(x, "<f4").astype(float)
    for b, (n, x) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([-1], pa.int64()), pa.array([n], pa.int64()), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["block", "part", "seen", "sums"])


def train(src: DataFrame, corpus: Corpus, rounds: int = ROUNDS) -> Model:
    """``src``: key and text of training documents, each in one of the rounds."""
    model = Model(*corpus.priors, rows=corpus.rows)
    blocks = DEPTH * corpus.rows * C // BLOCK
    tasks = 1 + corpus.total // rounds // max(TASK_TOKENS, 128 * corpus.rows)
    for k in range(rounds):
        priors, start = model.priors, model.w
        begun = np.float32(BEGUN * k)

        def steps(batches: Iterator[pa.RecordBatch], priors=priors, start=start, begun=begun) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            m = Model(*priors, w=[x.copy() for x in start])
            state, seen = [np.full(x.shape, begun, np.float32) for x in start], 0
            for part in pieces(batches, most=1 << 20):
                h, cls, off = tokens(part.column("text"))
                m.train(features(h, cls, off), cls, state)
                seen += len(h)
            if seen:  # changes weighted by tokens, as they are averaged
                change = np.concatenate([(a - b) * np.float32(seen) for a, b in zip(m.w, start)]).astype("<f4", copy=False).reshape(blocks, -1)
                part = TaskContext.get().partitionId()
                for b in range(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([change[b].tobytes()], pa.binary())], ["block", "part", "seen", "sums"])

        part = src.where(F.pmod(F.xxhash64("key", F.length("text")), F.lit(rounds)) == k).select("text")
        got = part.coalesce(tasks).mapInArrow(steps, MESSAGE)
        if tasks > FAN:  # in a tree: about the square root of the messages of a block meet in one task, then these
            got = got.repartition("block", F.pmod("part", F.lit(int(np.ceil(np.sqrt(tasks)))))).mapInArrow(_merged, MESSAGE)
        got = got.repartition("block").mapInArrow(_merged, MESSAGE).collect()  # as large as the weights
        if not got:
            continue
        new = np.zeros((blocks, BLOCK), np.float32)
        for r in got:
            new[r["block"]] = np.frombuffer(r["sums"], "<f4").astype(float) / r["seen"]
        model.w = [a + b for a, b in zip(model.w, new.reshape(DEPTH, corpus.rows, C))]
    return model


SCORED = "row bigint, key bigint, held_out boolean, n_tokens bigint, n_known bigint, s double, classes double, h bigint, tf bigint"
_SCORED = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("s", pa.float64()), ("classes", pa.float64()), ("h", pa.int64()), ("tf", pa.int64())])


def _scorer(model: Model, norm: np.ndarray, head: np.ndarray, head_c: np.ndarray):
    """A row for each text (tf null) with the head words' share, and one for each of its distinct other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log10(head_c + 0.5)
        for part in pieces(batches, most=4 << 20):
            h, cls, off = tokens(part.column("text"))
            rows = part.num_rows
            row = np.repeat(np.arange(rows), np.diff(off))
            at = np.minimum(np.searchsorted(head, h), max(len(head) - 1, 0))
            known = head[at] == h if len(head) else np.zeros(len(h), bool)
            s = np.bincount(row[known], logs[at[known]], rows) if known.any() else np.zeros(rows)
            classes = np.bincount(row, model.score(features(h, cls, off), cls) / np.log(10) - norm[cls], rows)
            yield pa.RecordBatch.from_arrays([
                part.column("row"), part.column("key"), part.column("held_out"), pa.array(np.diff(off)), pa.array(np.bincount(row[known], minlength=rows).astype(np.int64)),
                pa.array(s), pa.array(classes), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()),
            ], schema=_SCORED)
            far, far_row = h[~known], row[~known]
            order = np.lexsort((far, far_row))
            far, far_row = far[order], far_row[order]
            if len(far):
                first = np.flatnonzero(np.concatenate(([True], (far[1:] != far[:-1]) | (far_row[1:] != far_row[:-1]))))
                many = np.diff(np.append(first, len(far)))
                ids = part.column("row").to_numpy()[far_row[first]]
                none = [pa.nulls(len(first), f.type) for f in list(_SCORED)[1:7]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *none, pa.array(far[first].view(np.int64)), pa.array(many)], schema=_SCORED)

    return run


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    src = no_null(docs, key, text).withColumn("held_out", held_out())
    learn = src.where(~F.col("held_out"))
    counted = learn.select("text").mapInArrow(_count, COUNTS)
    counts = stage(counted.groupBy("h").agg(F.first("cls").alias("cls"), F.sum("c").alias("c")), "counts")
    corpus = Corpus(counts)
    model = train(learn.select("key", "text"), corpus)
    wide = src.withColumn("row", F.monotonically_increasing_id()).select("row", "key", "held_out", "text")
    scored = stage(wide.mapInArrow(_scorer(model, corpus.norm, corpus.head, corpus.head_c), SCORED), "scored")
    texts, far = scored.where("tf is null"), scored.where("tf is not null").select("row", "h", "tf")
    met = far.join(corpus.tail(counts).select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = met.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 0.5)).alias("s2"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known2"))
    s = F.col("s") + F.coalesce("s2", F.lit(0.0))
    norm = float(np.log10(corpus.total + 0.5 * (corpus.distinct + 1)))
    return texts.join(more, "row", "left").select(
        "key", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(corpus.total).cast("bigint").alias("train_tokens"),
        (s - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (s + F.col("classes")).alias("score"),
    )
