"""Vectorised hashing of words, shingles and byte n-grams over Arrow string buffers.

Texts are never split into Python strings: word borders are found in the UTF-8 bytes of a whole
Arrow batch, and the hash of a word is a difference of two prefix sums of a polynomial in an odd
base, modulo 2**64, then mixed. Work goes in blocks that fit the cache.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 17  # bytes of text hashed at a time; longer words are hashed by blake2b
_BASE = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64

#: White space between words, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters and digits and bytes of other scripts.
NON_WORD = np.ones(256, bool)
NON_WORD[48:58] = NON_WORD[65:91] = NON_WORD[97:123] = NON_WORD[128:] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
    powers = np.cumprod(np.full(_BLOCK + 1, _BASE, U64)) * U64(pow(int(_BASE), -1, 1 << 64))
    inverse = U64(pow(int(_BASE), -1, 1 << 64))
    return values[LOWER], powers, np.cumprod(np.full(_BLOCK + 1, inverse, U64)) * _BASE


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 offsets of the rows among them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~gap[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offs[(offs > 0) & (offs < len(buf))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, upper-case ASCII letters taken as lower-case."""
    values, powers, inverses = _tables()
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = int(np.searchsorted(ends, at + _BLOCK, side="right"))
        if j <= i:
            word = LOWER[buf[at : ends[i]]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            i += 1
            continue
        part = values[buf[at : ends[j - 1]]]
        part *= powers[: len(part)]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * inverses[s] + (e - s).astype(U64)
        i = j
    return mix(out)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text, in order; of the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U64)
    width = min(k, n)
    total = np.zeros(n - width + 1, U64)
    for j in range(width):
        total *= U64(0xD6E8FEB86659FD93)
        total += hashes[j : n - width + 1 + j]
    return mix(total + U64(width * 0x632BE5AB))


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each row."""
    buf, offs = text_bytes(column)
    starts, ends, rows = words(buf, offs)
    hashes = word_hashes(buf, starts, ends)
    return [np.unique(shingles(hashes[a:b], k)) for a, b in zip(rows[:-1], rows[1:], strict=True)]
