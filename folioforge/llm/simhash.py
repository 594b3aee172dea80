"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has a bit set if over half of its word shingles' XXH64 values have it set.
Copies with one fingerprint are one node.  Each distinct fingerprint gets the keys of
:mod:`.golay`: its segments decode to nearby codeword indices, joined with exact parts such that
any two fingerprints within ``MOST`` bits share a key.  Fingerprints meet by key, every meeting is
verified by counting differing bits, and a task passes on no more than a spanning forest of what it
verified.  The links' connected components are the groups.

A key shared by over ``GROUP`` fingerprints is not compared in one task: its fingerprints are dealt
into blocks, and each pair of blocks is a task of its own, so the result stays whole.  Such keys are foreseen
from the keys of one fingerprint in ``SAMPLE`` and dealt before the shuffle; one that the sample missed is
found as it streams by, and dealt then.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words
than a shingle are one shingle; repeated rows link; a null id is kept, and a component's id is its
least id that is not null.  An empty table gives an empty result.  Further columns are not read by
:func:`groups` and kept by :func:`deduplicate`.  Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_null, pieces, stage
from .components import components
from .golay import keys

MOST = 4
SHINGLE = 4
SEED = 42
GROUP = 4096
#: One fingerprint in so many, chosen by hash, tells which keys are hot.  It decides on the route only, not on the result.
SAMPLE = 64
#: The most foreseen keys that are broadcast; beyond it they are joined by shuffle.
BROADCAST_KEYS = 1 << 18


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest as h

    words = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at 20 and 09-0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        value = np.array([h(line, SEED)], "<u8")
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        value = np.array([h(line[a:b], SEED) for a, b in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(value), 4096):
        ones += np.unpackbits(value[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(value), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, text_hash (of the text, by Spark's xxhash64), fp (the 64 bits as a signed long); a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            fp = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("text_hash"), pa.array(fp)], ["key", "text_hash", "fp"])

    src = no_null(docs, key, text).withColumn("text_hash", F.xxhash64("text"))
    return src.mapInArrow(run, "key bigint, text_hash bigint, fp bigint")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 8192):
            some = fp[at : at + 8192]
            k, row = keys(some.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(some[row])], ["key", "fp"])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what (u, v) connect, one for each node that isn't a root."""
    node, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (up := new[new]).tobytes() != new.tobytes():
            new = up
        if (new == root).all():
            break
        root = new
    off = root != np.arange(len(node))
    return node[off], node[root[off]]


def linked(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between fingerprints of one key; rows in the order of keys."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bits, at, d, held = fp.view(np.uint64), np.arange(len(key)), 1, 0
    while True:
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            return forest(np.concatenate(u), np.concatenate(v))
        near = at[np.bitwise_count(bits[at] ^ bits[at + d]) <= most]
        u.append(fp[near])
        v.append(fp[near + d])
        held += len(near)
        if held > 1 << 20:
            a, b = forest(np.concatenate(u), np.concatenate(v))
            u, v, held = [a], [b], 0
        d += 1


def _linker(most: int, group: int | None):
    """Rows come in the order of keys.  (u, v, null) is a link; (fp, null, key) is a row of a key with over ``group`` rows."""

    def out(u, v, key) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(key, pa.int64())], ["u", "v", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            if hot is not None:  # rows of a hot key go on
                n = len(k) if (k == hot).all() else int(np.argmax(k != hot))
                if n:
                    yield out(f[:n], [None] * n, k[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                hot = None
            key, fp = np.concatenate((key, k)), np.concatenate((fp, f))
            if not len(key):
                continue
            open_ = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
            if group is not None and len(key) - open_ > group:
                yield out(fp[open_:], [None] * (len(key) - open_), key[open_:])
                hot = int(key[-1])
                done, done_fp, key, fp = key[:open_], fp[:open_], key[:0], fp[:0]
            else:
                done, done_fp, key, fp = key[:open_], fp[:open_], key[open_:], fp[open_:]
            yield from settle(done, done_fp)
        yield from settle(key, fp)

    def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        if group is not None:
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(heads, len(key)))
            big = np.repeat(size > group, size)
            if big.any():
                yield out(fp[big], [None] * int(big.sum()), key[big])
                key, fp = key[~big], fp[~big]
        u, v = linked(key, fp, most)
        if len(u):
            yield out(u, v, [None] * len(u))

    return run


LINKED = "u bigint, v bigint, key bigint"


def _dealt(rows: DataFrame) -> DataFrame:
    """(key, fp, blocks) to (key, fp): each block of a key's fingerprints meets each other block, and itself, under a key
    of their own; rows without ``blocks`` stay under their key."""
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.expr("sequence(0, blocks - 1)"))
    met = rows.withColumn("block", block).withColumn("other", F.explode(others))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return met.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(pair).alias("key"), "fp")


def links(nodes: DataFrame, most: int = MOST, group: int = GROUP, sample: int = SAMPLE) -> DataFrame:
    """(u, v) over distinct fingerprints (column fp): a forest with the components of all links."""
    keyed = lambda some: some.select("fp").mapInArrow(_keyed, "key bigint, fp bigint")
    few = keyed(nodes.where(F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.lit(sample)) == 0))
    hot = few.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * sample > group)
    hot = stage(hot.select("key", F.ceil(F.col("n") * sample / group).cast("int").alias("blocks")), "hot-keys")
    n, rows = hot.count(), keyed(nodes)
    if n:
        rows = _dealt(rows.join(F.broadcast(hot) if n <= BROADCAST_KEYS else hot, "key", "left"))
    met = stage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(most, 2 * group), LINKED), "links")
    edges = met.where("key is null").select("u", "v")
    missed = met.where("key is not null").select("key", F.col("u").alias("fp"))
    if missed.isEmpty():
        return edges
    size = missed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("blocks"))
    again = _dealt(missed.join(size, "key")).repartition("key").sortWithinPartitions("key")
    return edges.unionByName(again.mapInArrow(_linker(most, None), LINKED).select("u", "v"))


def _classes(prints: DataFrame, most: int) -> DataFrame:
    """fp -> component_id, the least key of all rows that can be reached.

    Minima are staged before rows are joined to them, so that both sides of a join are plain shuffles and
    a component or a group of copies with very many rows is split by adaptive execution."""
    nodes = stage(prints.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    linked_ = nodes.join(components(links(nodes, most)).withColumnRenamed("node", "fp"), "fp")
    least = stage(linked_.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    classes = linked_.select("fp", "root").join(least, "root").select("fp", "component_id")
    single = nodes.join(classes, "fp", "left")
    # a linked fingerprint without a component's id has no row with a key in reach
    return stage(single.select("fp", F.coalesce("component_id", "first").alias("component_id")), "classes")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: key, text_hash, fp, component_id."""
    prints = stage(fingerprints(docs, key, text, shingle), "prints")
    return prints.join(_classes(prints, most), "fp").select("key", "text_hash", "fp", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group: the one with the least key (rows without one last), then the least text hash."""
    member = groups(docs, key, text, most, shingle)
    # one row a component: a minimum, so each task passes on one row for each component it sees
    order = F.struct(F.col("key").isNull().alias("no_key"), "key", "text_hash")
    keep = member.withColumn("class", F.coalesce("component_id", "fp")).groupBy("class", F.col("component_id").isNull()).agg(F.min(order).alias("one")).select(F.col("one.key").alias("_key"), F.col("one.text_hash").alias("_hash"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names)
    at = docs.columns.index
    wide = wide.withColumn("_key2", F.col(names[at(key)])).withColumn("_hash2", F.xxhash64(F.coalesce(F.col(names[at(text)]), F.lit(""))))
    kept = wide.join(keep, F.col("_key2").eqNullSafe(F.col("_key")) & (F.col("_hash2") == F.col("_hash")))
    return kept.dropDuplicates(["_key2", "_hash2"]).select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])
