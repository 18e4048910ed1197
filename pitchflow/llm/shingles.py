"""Vectorised word and shingle hashing over the UTF-8 bytes of an Arrow string column.

Words are maximal runs of bytes other than [\\x20\\x09-\\x0D]; A-Z count as a-z. All of these are
single bytes in UTF-8, so bytes give the same words as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WIDTH = 5
#: Texts are taken together up to so many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> _Powers:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                factors = np.full(n, base, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offs[0] : offs[-1]] if len(offs) else bytes_[:0], offs - (offs[0] if len(offs) else 0)


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together, or one text."""
    n, at = len(offs) - 1, 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    is_word = IS_WORD[data]
    start, stop = is_word.copy(), is_word.copy()
    start[1:] &= ~is_word[:-1]
    stop[:-1] &= ~is_word[1:]
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    start[first], stop[last] = is_word[first], is_word[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(offs, s, side="right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    powers = _powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * powers.up[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * powers.down[s] + (e - s).astype(np.uint64))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 5-word shingles of each text as 64-bit hashes.

    A text of 1 to 4 words has one shingle of all its words; a null, empty or blank text has none.
    """
    data, offs = byte_view(column)
    for a, b in chunks(offs):
        part, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        s, e, doc = words(part, o)
        h = word_hashes(part, s, e)
        counts = np.bincount(doc, minlength=b - a)
        ends = np.cumsum(counts)
        grams = np.zeros(0, dtype=np.uint64)
        if len(h) >= WIDTH:
            grams = sum(h[j : len(h) - WIDTH + 1 + j] * _PLACE[j] for j in range(WIDTH))
            grams = mix(grams)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= WIDTH:
                got = np.sort(grams[end - n : end - WIDTH + 1])
                yield got[np.concatenate(([True], got[1:] != got[:-1]))]
            elif n:
                yield mix((h[end - n : end] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield grams[:0]
