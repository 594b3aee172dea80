"""Whole-text BPE encoding with the ``tokenizers`` library, memoised by pre-token.

A BPE vocabulary splits a text into pre-tokens first and merges inside each of them, so the ids of a
text are the joined ids of its pre-tokens.  :class:`MemoEncoder` keeps the ids of pre-tokens it has
seen (bounded by ``max_entries``, begun anew when full) and hands only unseen ones to the tokenizer.
A text outside the alphabet for which the split is reproduced here (Latin letters up to U+024F), or with
the string of an added token in it, goes to the tokenizer as it is, so the ids are the tokenizer's own
for every text: those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, which
gives such a string its token's id.  With ``special_as_text`` it is encoded like any other text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np

# Fixed value: the byte-level pre-tokenizer's published split, with letters and digits filled in.
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"

_LATIN = [chr(i) for i in range(0x20, 0x250) if not 0x7F <= i <= 0xA0 and i not in (0xAD, 0x130)]
_LETTERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
_OUTSIDE = re.compile("[^\\t\\n\\r" + re.escape("".join(_LATIN)) + "]")


#: A byte -> its character in the byte-level alphabet: printable Latin-1 stands for itself, the others follow at U+0100.
_SELF = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
ALPHABET = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SELF)}


#: Longer pre-tokens are not kept, so a memo's size is bounded.
LONGEST = 64


class _Memo(dict):
    """pre-token -> its ids as little-endian bytes; an unseen one goes to the tokenizer's model."""

    def __init__(self, model, most: int, kind: str) -> None:
        super().__init__()
        self.tokenize, self.most, self.kind = model.tokenize, most, kind

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", ALPHABET[32])
        else:
            letters = piece.encode().decode("latin-1").translate(ALPHABET)
        ids = [t.id for t in self.tokenize(letters)]
        out = struct.pack(f"<{len(ids)}{self.kind}", *ids)
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out


class MemoEncoder:
    """``encode(text)`` returns the ids of the whole text as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, max_entries: int = 600_000, width: int = 4, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else self.tokenizer.get_added_tokens_decoder().values()
        #: Strings of added tokens that are looked for in the text, and those that are in its normalised form.
        self.added, self.added_low = [t.content for t in added if not t.normalized], [t.content.lower() for t in added if t.normalized]
        if self.tokenizer.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"the vocabulary's ids do not fit {width} bytes")
        self.kind, self.dtype = ("H", "<u2") if width == 2 else ("I", "<u4")
        self.memo = _Memo(self.tokenizer.model, max_entries, self.kind)
        self.lower = False
        with open(path, encoding="utf-8") as f:
            self.split = self._split(json.load(f))

    def _split(self, spec: dict):
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            pattern = _BYTE_SPLIT
        elif (
            [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and pre["pretokenizers"][0]["behavior"] == "Removed"
            and pre["pretokenizers"][0]["invert"]
        ):
            self.lower = True
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
            pattern = pattern.replace(r"[\p{L}]", "[{L}]").replace(r"[\p{N}]", "[{N}]").replace(r"\p{L}", "{L}").replace(r"\p{N}", "{N}")
        else:
            return None
        return re.compile(pattern.replace("{L}", _LETTERS).replace("{N}", _NUMBERS)).findall

    def encode(self, text: str) -> bytes:
        if self.split is None or _OUTSIDE.search(text) or any(x in text for x in self.added) or self.added_low and any(x in text.lower() for x in self.added_low):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.memo.__getitem__, self.split(text.lower() if self.lower else text)))


@lru_cache(maxsize=1)
def shared(job: str, path: str, max_entries: int = 600_000, width: int = 4, special_as_text: bool = False) -> MemoEncoder:
    """The encoder that one job's tasks share in a Python worker; another job begins with nothing."""
    return MemoEncoder(path, max_entries, width, special_as_text)
