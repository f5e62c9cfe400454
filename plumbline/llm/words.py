"""Words and Rabin-Karp hashes of UTF-8 texts, as numpy arrays over a whole batch.

A word is a maximal run of bytes other than space and 0x09 to 0x0D.  Texts lie one
behind the other in one byte array, as Arrow keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
SLICE_BYTES = 1_000_000

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2**64 for i below ``n`` (base is odd)."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)

        def run(b: int) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        _POWERS[base] = run(base), run(pow(base, -1, 1 << 64))
    up, down = _POWERS[base]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of ``values[start:end]`` for each pair, by differences of one prefix sum."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; each text stays whole."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


@dataclass
class Words:
    """``starts`` and ``ends`` are byte positions, ``text`` the index of the text, ``first`` where its words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return rolling(data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, BYTE_BASE)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[cuts] = inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[cuts[1:] - 1] = inside[cuts[1:] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def windows(hashes: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``width`` words inside one text."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text[: len(text) - width + 1] == text[width - 1 :])
    return at, rolling(hashes, at, at + width, WORD_BASE)


def shingles(words: Words, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of each distinct shingle, in order of text.

    A text of 1 to ``width - 1`` words has one shingle, all its words; one without words has none.
    """
    hashes = words.hashes(lower)
    at, found = windows(hashes, words.text, width)
    text = words.text[at]
    n = words.counts()
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = rolling(hashes, words.first[short], words.first[short + 1], WORD_BASE)
        whole = mix(whole + n[short].astype(np.uint64))
        text, found = np.concatenate([text, short]), np.concatenate([found, whole])
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    return text[fresh], found[fresh]


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``data[start:start + length]``, one behind the other."""
    total = int(lengths.sum())
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(starts) else starts
    return data[np.repeat(shift, lengths) + np.arange(total)]
