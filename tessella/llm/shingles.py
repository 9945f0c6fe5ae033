"""Sets of word shingles as sorted arrays of 64-bit hashes.

Words are runs of other bytes than space and U+0009 to U+000D, A-Z lower-cased. All words of a batch of texts are
hashed at once, on the bytes that Arrow holds: a word's hash is a difference of prefix sums of its bytes' values times
powers of a base, moved to a common start by the inverse power.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_MIX, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x2545F4914F6CDD1D
#: Bytes of texts hashed at once, if no text is longer.
_BYTES = 1 << 20
#: Bits of a set's bitmap.
SIG_BITS = 2048
#: Value of each byte, upper-case letters like their lower-case ones; 0 for white space.
_VALUE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[[9, 10, 11, 12, 13, 32]] = 0


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x ^= x >> np.uint64(29)
    return x


def _hashed(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted shingles of each text of ``data`` (bytes; text i is from offsets[i] to offsets[i + 1])."""
    if not len(data):
        for _ in range(len(offsets) - 1):
            yield np.zeros(0, np.uint64)
        return
    power, inverse = _powers(1 << max(20, len(data).bit_length()))
    value = _VALUE[data]
    inside = value != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[bounds < len(data)]
    first[bounds] = inside[bounds]  # a word ends where its text does
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value * power[: len(data)], out=sums[1:])
    word = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)  # the words of text i are those from at[i] to at[i + 1]
    n = max(0, len(word) - words + 1)
    run = word[:n].copy()
    for i in range(1, words):
        run *= _MIX_2
        run += word[i : i + n]
    run = _mixed(run)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(run[a : b - words + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            few = np.array([b - a], np.uint64)
            for h in word[a:b]:
                few = _mixed(few * _MIX + h)
            yield few
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingles, sorted, of each text; a text of fewer words is one shingle, one of none (or null) has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"") if not pa.types.is_large_binary(texts.type) else texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BYTES, side="right")) - 1)
        j = min(j, len(texts))
        yield from _hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
        i = j


def set_key(shingles: np.ndarray) -> bytes:
    """A digest that equal sets, and no others, share."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(SIG_BITS, bool)
    bits[(shingles >> np.uint64(64 - SIG_BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()
