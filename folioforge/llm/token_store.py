"""Token-id output in binary shards, compressed per document with one shared zstandard dictionary.

Documents are dealt by ranges of their id, encoded whole, and written by Spark as rows of Parquet,
each a binary shard; Spark's committer keeps one attempt of every task, so a lost executor leaves no
half shard.  A shard is

    magic "FFZD1", then little-endian: uint32 part, uint64 tokens of the part before it, uint32 n,
    uint32 bytes an id takes (2 if the vocabulary fits, else 4), 32 bytes SHA-256 of the dictionary,
    int64[n] document ids, uint8[n] id is null, uint32[n] token counts, uint64[n + 1] offsets, then
    n zstandard frames of token ids

and one frame of a shard can be read without the others.  A store is a folder of three tables:
``shards``; ``parts``, the tokens before each part, a row for each task that wrote; ``meta``, one row with
the dictionary, its SHA-256, the end id and the bytes an id takes.  :func:`open_store` opens it anywhere.

The dictionary is trained on serialized id arrays of at most ``DICT_DOCS`` documents (those of the lowest
hashed ids), a stretch of ``DICT_BYTES`` characters of each at a hashed place; it bears on size only, never
on what is read back.  A reader refuses a shard whose dictionary hash differs from the dictionary's.

Defined cases: a null or empty text is its end id alone.  Rows with one id are in the order of their text's
first ``PREFIX`` characters, then of a hash of the text, so that an id of very many rows is dealt to many
tasks; null ids come first.  An empty table has no shards and reads back empty.  Further columns are not
read.  Texts of any length are one frame.  Ids are long integers.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_null, pieces, shared_dir
from .memo_bpe import shared

MAGIC = b"FFZD1"
HEAD = "<5sIQII32s"
DICT_DOCS, DICT_BYTES, DICT_SIZE = 512, 16 << 10, 64 << 10
SHARD_BYTES = 4 << 20
PREFIX = 48
#: The most rows of ``parts`` (one for each task that wrote) that are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1 << 20
SHARDS, PARTS = "part bigint, tokens bigint, n_docs bigint, shard binary", "part bigint, before bigint"
META = "version int, end_id bigint, width int, dictionary binary, dictionary_sha256 binary"


class Store:
    """What is in a store's folder.  ``shards``: part, tokens, n_docs, shard (binary).  ``parts``: part, before.
    ``dictionary``: bytes, may be empty."""

    def __init__(self, path: str, shards: DataFrame, parts: DataFrame, dictionary: bytes, end_id: int, width: int) -> None:
        self.path, self.shards, self.parts, self.dictionary, self.end_id, self.width = path, shards, parts, dictionary, end_id, width


def open_store(spark: SparkSession, path: str) -> Store:
    """A store that was written before, by whatever session; all it needs is in its folder."""
    meta = spark.read.schema(META).parquet(f"{path}/meta").first()
    if meta is None or meta["version"] != 1 or hashlib.sha256(meta["dictionary"]).digest() != bytes(meta["dictionary_sha256"]):
        raise ValueError(f"no token store of version 1, or its dictionary is damaged: {path}")
    return Store(path, spark.read.schema(SHARDS).parquet(f"{path}/shards"), spark.read.schema(PARTS).parquet(f"{path}/parts"), bytes(meta["dictionary"]), meta["end_id"], meta["width"])


def _zdict(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def train_dictionary(src: DataFrame, encoder: tuple, end_id: int) -> bytes:
    import zstandard

    enc = shared(*encoder)
    chosen = src.select(F.xxhash64("key").alias("h")).orderBy("h").limit(DICT_DOCS)  # hashes alone, then the chosen ones' texts
    rows = src.withColumn("h", F.xxhash64("key")).join(F.broadcast(chosen.distinct()), "h", "left_semi")
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - DICT_BYTES, F.lit(0)).cast("bigint") + 1).cast("int") + 1
    few = rows.select(F.substring(F.col("text"), place, F.lit(DICT_BYTES)).alias("text")).orderBy("text").limit(DICT_DOCS)
    samples = [(enc.encode(r["text"]) + end_id.to_bytes(encoder[3], "little"))[:DICT_BYTES] for r in few.collect()]
    try:
        return zstandard.train_dictionary(DICT_SIZE, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their content itself serves as the dictionary
        return b"".join(samples)[:DICT_SIZE]


def _width(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4


def _writer(encoder: tuple, end_id: int, dictionary: bytes):
    digest, width = hashlib.sha256(dictionary).digest(), encoder[3]
    end = end_id.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        enc, z = shared(*encoder), zstandard.ZstdCompressor(level=1, dict_data=_zdict(dictionary), write_content_size=True)
        keys: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        size = 0

        def shard() -> pa.RecordBatch:
            n = len(keys)
            where = np.zeros(n + 1, "<u8")
            np.cumsum([len(x) for x in frames], out=where[1:])
            blob = b"".join([
                struct.pack(HEAD, MAGIC, part, before, n, width, digest), np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], "u1").tobytes(),
                np.array(counts, "<u4").tobytes(), where.tobytes(), *frames,
            ])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())], ["part", "tokens", "n_docs", "shard"])

        for batch in pieces(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                ids = enc.encode(text) + end
                keys.append(key)
                counts.append(len(ids) // width)
                frames.append(z.compress(ids))
                size += len(frames[-1])
                if size >= SHARD_BYTES:
                    yield shard()
                    before += sum(counts)
                    keys, counts, frames, size = [], [], [], 0
        if keys:
            yield shard()

    return run


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 1, key: str = "doc_id", text: str = "text", memo: int = 600_000, path: str | None = None, special_as_text: bool = False) -> Store:
    """Write a store to ``path`` (which must not be there yet; a new folder in the shared one if none is given) and open it."""
    spark, width = docs.sparkSession, _width(vocabulary)
    path = path or f"{shared_dir(spark)}/folioforge/tokens-{uuid.uuid4().hex}"
    src, encoder = no_null(docs, key, text), (uuid.uuid4().hex, vocabulary, memo, width, special_as_text)
    dictionary = train_dictionary(src, encoder, end_id)
    # ranges of (id, text) without whole texts among the bounds; a running number splits rows that are equal in all
    by = src.withColumns({"prefix": F.substring("text", 1, PREFIX), "hash": F.xxhash64("text"), "number": F.monotonically_increasing_id()})
    dealt = by.repartitionByRange("key", "prefix", "hash", "number").sortWithinPartitions("key", "prefix", "hash").select("key", "text")
    dealt.mapInArrow(_writer(encoder, end_id, dictionary), SHARDS).write.option("compression", "none").parquet(f"{path}/shards")
    base, total = [], 0
    for part, tokens in spark.read.schema(SHARDS).parquet(f"{path}/shards").groupBy("part").agg(F.sum("tokens")).orderBy("part").collect():  # a row for each task that wrote
        base.append((part, total))
        total += tokens
    spark.createDataFrame(base, PARTS).coalesce(1).write.parquet(f"{path}/parts")
    # last, as a store without it cannot be opened
    spark.createDataFrame([(1, end_id, width, dictionary, hashlib.sha256(dictionary).digest())], META).coalesce(1).write.parquet(f"{path}/meta")
    return open_store(spark, path)


def open_shard(blob: bytes, dictionary: bytes):
    """part, tokens of the part before the shard, the ids' dtype, document ids, token counts, frame offsets, the frames' bytes."""
    magic, part, before, n, width, digest = struct.unpack_from(HEAD, blob)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a shard written with this dictionary")
    at = struct.calcsize(HEAD)
    cols = []
    for kind, many in (("<i8", n), ("u1", n), ("<u4", n), ("<u8", n + 1)):
        cols.append(np.frombuffer(blob, kind, many, at))
        at += cols[-1].nbytes
    keys = [None if null else k for k, null in zip(cols[0].tolist(), cols[1].tolist())]
    return part, before, f"<u{width}", keys, cols[2].astype(np.int64), cols[3].astype(np.int64), memoryview(blob)[at:]


def read_document(blob: bytes, dictionary: bytes, index: int) -> np.ndarray:
    """The ids of one document of a shard; the others stay compressed."""
    import zstandard

    _, _, kind, _, _, where, frames = open_shard(blob, dictionary)
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_zdict(dictionary)).decompress(frames[where[index] : where[index + 1]]), kind)


def read_tokens(store: Store) -> DataFrame:
    """key, start, ids (little-endian uint32 bytes), n_tokens; one row for each document of the shards."""
    dictionary = store.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))
        for batch in batches:
            for i in range(batch.num_rows):
                _, before, kind, keys, counts, where, frames = open_shard(batch.column("shard")[i].as_py(), dictionary)
                start = batch.column("before")[i].as_py() + before + np.concatenate(([0], np.cumsum(counts)[:-1]))
                for a in range(0, len(keys), 256):
                    b = min(a + 256, len(keys))
                    ids = [np.frombuffer(z.decompress(frames[where[k] : where[k + 1]]), kind).astype("<u4").tobytes() for k in range(a, b)]
                    if [len(x) >> 2 for x in ids] != counts[a:b].tolist():
                        raise ValueError("a frame differs from the shard's token counts")
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(start[a:b], pa.int64()), pa.array(counts[a:b], pa.int64()), pa.array(ids, pa.binary())], ["key", "start", "n_tokens", "ids"])

    parts = F.broadcast(store.parts) if store.parts.count() <= BROADCAST_ROWS else store.parts
    return store.shards.join(parts, "part").select("before", "shard").mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids binary")
