"""What the operators share: the cluster's shared folder, staged tables, Arrow batches cut to a
bounded text size, and word hashing on UTF-8 buffers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, removed at exit."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of the lineage that
    survives lost executors, as Spark's committer keeps one attempt of every task."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioforge/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that this process staged, and return how many; results that were not written yet need them."""
    jvm, n = spark.sparkContext._jvm, 0
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def no_null(df: DataFrame, key: str, text: str):
    """``key`` (a long integer, or what is declared for the operator) and ``text`` alone, a null text as empty; further
    columns never reach Python."""
    from pyspark.sql import functions as F

    return df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows:
            ends = np.cumsum(lengths(batch.column(column)))
            at = 0
            while at < batch.num_rows:
                base = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
                yield batch.slice(at, to - at)
                at = to


def lengths(array: pa.Array) -> np.ndarray:
    return np.diff(offsets(array))


def offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and the rows' offsets in them."""
    off = offsets(array)
    data = array.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.zeros(0, np.uint64)


def odd(n: int) -> np.ndarray:
    """The first ``n`` of a fixed sequence of odd 64-bit multipliers."""
    global _ODD
    if len(_ODD) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _ODD = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _ODD[:n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing, and [^\x20\x09-\x0D].
ALNUM = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
INK = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def word_spans(data: np.ndarray, off: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word (a longest run of ``of_word`` bytes within a row), and each row's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = of_word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < n]
    begin[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tails = off[1:][off[1:] > 0] - 1
    end[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
SHORT = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, from its bytes eight at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))  # those from each byte on
    lengths_ = odd(SHORT + 1)
    h = mix((eight[starts] & _MASK[np.minimum(size, 8)]) ^ lengths_[np.minimum(size, SHORT)])
    more, k = np.flatnonzero((size > 8) & (size <= SHORT)), 8
    while len(more):
        x = eight[starts[more] + k] & _MASK[np.minimum(size[more] - k, 8)]
        h[more] = mix((h[more] ^ x) * lengths_[0] + np.uint64(k))
        k += 8
        more = more[size[more] > k]
    long = np.flatnonzero(size > SHORT)
    if len(long):
        from xxhash import xxh64_intdigest

        raw = data.tobytes() if len(long) > 64 else None
        for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
            h[i] = xxh64_intdigest(raw[a:b] if raw else data[a:b].tobytes(), 1)
    return h
