"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the turns' spans, sorted, are
intersected with the tokens' spans by binary search: a token is under the mask if it lies in an
assistant's text.  The three control strings are tokens of their own, so no token crosses a text's
ends.  Ids come from the memoised encoder of :mod:`.memo_bpe`; a byte-level token stands for as many bytes
as its name has letters, so the running sum of these gives each token's place.  Ids and offsets are those of
the ``tokenizers`` library with the control strings added (:func:`tokenizer`); other vocabularies go to it.  In roles and texts ``\\`` is written ``\\\\`` and ``<|`` is written ``<\\|``, so no control string
can arise from them and reading back is exact.

Rows are dealt by conversation and sorted by turn (ties by role, then text), and a conversation is
put together as its rows stream by; one conversation's text is what a task holds.

Defined cases: null roles and texts are empty, a null turn comes first, a null id is a conversation
of its own, repeated rows are turns of their own, an empty text has no token and an empty span, an
empty table gives an empty result, further columns are not read, texts are never cut.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo_bpe import ALPHABET, shared

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_CONTROL = re.compile("(" + "|".join(map(re.escape, (START, SEP, END))) + ")")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return text if "\\" not in text else re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted text, and starts and ends of the spans of the texts to be learned."""
    out, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        if role == learn:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), starts, ends


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def tokenizer(path: str):
    """The vocabulary with the control strings as tokens; offsets keep white space."""
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([START, SEP, END])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


class Offsets:
    """Ids and offsets (in code points) of rendered conversations."""

    def __init__(self, vocabulary: str, job: str) -> None:
        self.library = tokenizer(vocabulary)
        self.memo = shared(job, vocabulary, 600_000, 4)
        names = self.library.get_vocab(with_added_tokens=True)
        self.control = {c: np.array([names[c]], "<u4").tobytes() for c in (START, SEP, END)}
        self.size = np.zeros(max(names.values()) + 1, np.int64)
        plain = set(ALPHABET.values())
        self.plain = self.memo.split is not None and not self.memo.lower
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        for name, i in names.items():
            self.size[i] = len(name.encode()) if name in added else len(name)
            self.plain &= name in added or plain.issuperset(name)

    def __call__(self, formatted: str) -> tuple[np.ndarray, np.ndarray]:
        if not self.plain:
            e = self.library.encode(formatted, add_special_tokens=False)
            return np.array(e.ids, np.int32), np.fromiter(chain.from_iterable(e.offsets), np.int32).reshape(-1, 2)
        ids = np.frombuffer(b"".join([self.control.get(x) or self.memo.encode(x) for x in _CONTROL.split(formatted) if x]), "<u4").astype(np.int32)
        ends = np.cumsum(self.size[ids])
        if formatted.isascii():
            return ids, np.stack([ends - self.size[ids], ends], 1).astype(np.int32)
        data = np.frombuffer(formatted.encode(), np.uint8)
        point = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte, its code point's number
        return ids, np.stack([point[ends - self.size[ids]], point[ends - 1] + 1], 1).astype(np.int32)


def mask(starts: list[int], ends: list[int], offsets: np.ndarray) -> np.ndarray:
    """Whether each token (start, end) lies in one of the sorted spans."""
    if not len(starts) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(starts, offsets[:, 0], "right") - 1
    return (at >= 0) & (offsets[:, 1] <= np.asarray(ends)[at]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, under: np.ndarray) -> str:
    """What the tokens under the mask cover, each place once, unescaped run by run."""
    at = offsets[under]
    if not len(at):
        return ""
    reach = np.maximum.accumulate(at[:, 1])
    first = np.flatnonzero(np.concatenate(([True], at[1:, 0] > reach[:-1])))
    ends = reach[np.append(first[1:] - 1, len(at) - 1)]
    return "".join(unescape(formatted[a:b]) for a, b in zip(at[first, 0].tolist(), ends.tolist()))


_SCHEMA = pa.schema([("key", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])


def format_conversations(rows: DataFrame, vocabulary: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant", batch_chars: int = 1 << 20) -> DataFrame:
    """Per conversation: key, formatted, and for each token ids, starts, ends (code points), loss."""
    job = uuid.uuid4().hex
    src = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, turns = None, []
        for batch in batches:
            for k, r, t in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text"))):
                if turns and k != last:
                    yield last, turns
                    turns = []
                last = k
                turns.append((r, t))
        if turns:
            yield last, turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets_of = Offsets(vocabulary, job)
        cols: list[list] = [[] for _ in _SCHEMA]
        size = 0
        for k, turns in whole(batches):
            formatted, starts, ends = render(turns, learn)
            ids, offsets = offsets_of(formatted)
            for c, v in zip(cols, (k, formatted, ids, offsets[:, 0], offsets[:, 1], mask(starts, ends, offsets))):
                c.append(v)
            size += len(formatted)
            if size >= batch_chars:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)
                cols, size = [[] for _ in _SCHEMA], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    return src.repartition("key").sortWithinPartitions("key", "turn", "role", "text").mapInArrow(run, "key bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output: turns from the formatted text, the learned text from offsets and mask."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            of, loss = batch.column("starts").offsets.to_numpy(), batch.column("loss").values.to_numpy(zero_copy_only=False)
            places = np.stack([batch.column(c).values.to_numpy() for c in ("starts", "ends")], 1)
            for key, text, a, b in zip(batch.column("key").to_pylist(), batch.column("formatted").to_pylist(), of[:-1].tolist(), of[1:].tolist()):
                turns = read_back(text)
                learned = masked_text(text, places[a:b], loss[a:b])
                rows.append((key, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text)))
            names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    return formatted.mapInArrow(run, "key bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
