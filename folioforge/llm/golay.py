"""The binary Golay code [23, 12, 7] and the fuzzy keys of 64-bit fingerprints made from it.

The code is perfect: every 23-bit word is within 3 bits of exactly one codeword.  The codewords
within 4 bits of a word are that one and, if it is 3 bits away, five more.  Two words that differ in
at most 2 bits have one of these codewords in common, so the codewords' 12-bit indices are keys by
which such words meet.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

from .common import mix

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(x: int) -> int:
    for k in range(22, 10, -1):
        if x >> k & 1:
            x ^= GENERATOR << (k - 11)
    return x


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The remainder of each 12 high bits; of each remainder, the errors to codewords within 4 bits (6 places,
    the first one repeated where there is but one) and their number."""
    high = np.array([_remainder(h << 11) for h in range(4096)], np.uint32)
    bit = [_remainder(1 << k) for k in range(23)]
    errors: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for k in at:
                s ^= bit[k]
            if weight < 4 or errors[s][0].bit_count() == 3:
                errors[s].append(sum(1 << k for k in at))
    many = np.array([len(e) for e in errors], np.int64)
    return high, np.array([(e * 6)[:6] for e in errors], np.uint32), many


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices (n, 6) of the codewords within 4 bits of each 23-bit word, and how many there are (1 or 6)."""
    high, errors, many = tables()
    words = words.astype(np.uint32)
    s = high[words >> np.uint32(11)] ^ (words & np.uint32(2047))
    return (words[:, None] ^ errors[s]) >> np.uint32(11), many[s]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row of ``fp``) pairs such that fingerprints that differ in at most 4 bits share a key.

    The segments A and B have 23 bits, C has 18 (padded by zeros), with a, b and c errors, a + b + c <= 4:
    c = 0          then a <= 2 or b <= 2: C exact with A's or B's codewords
    a = 0, b <= 2  A exact with B's codewords;  b = 0, a <= 2  the reverse
    a = 0, b >= 3  then c <= 1: A exact with a half of C exact;  b = 0, a >= 3  the same with B
    none 0         then one of them has at most 2 errors and the others have 1 each, so that a half of
                   each of the others is exact: the codewords of one with halves of the two others.
    Each key has 30 bits of the fingerprint or more."""
    u = np.uint64
    a, b, c = fp >> u(41), fp >> u(18) & u((1 << 23) - 1), fp & u((1 << 18) - 1)
    half = {"a": (a >> u(11), a & u(2047)), "b": (b >> u(11), b & u(2047)), "c": (c >> u(9), c & u(511))}
    whole = {"a": a, "b": b, "c": c}
    near = {k: indices(v) for k, v in whole.items()}
    rows = np.arange(len(fp))
    out_key, out_row, family = [], [], 0

    def put(value: np.ndarray, row: np.ndarray) -> None:
        nonlocal family
        family += 1
        out_key.append(mix(value + u(family * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
        out_row.append(row)

    def fuzzy(seg: str, exact: np.ndarray) -> None:
        found, many = near[seg]
        keep = np.arange(6)[None, :] < many[:, None]
        at = np.nonzero(keep)
        put(mix(exact)[at[0]] ^ found[at].astype(np.uint64), rows[at[0]])

    fuzzy("a", c)
    fuzzy("b", c)
    fuzzy("b", a)
    fuzzy("a", b)
    for seg in "ab":
        for h in half["c"]:
            put(mix(whole[seg]) ^ h, rows)
    for seg, x, y in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b")):
        for i, p in enumerate(half[x]):
            for j, q in enumerate(half[y]):
                fuzzy(seg, p << u(20) | q << u(4) | u(2 * i + j))
    return np.concatenate(out_key), np.concatenate(out_row)
