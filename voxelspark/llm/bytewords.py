"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = 0x9E3779B97F4A7C15
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes that end a word: the space and 0x09-0x0D.
SPACES = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
#: Bytes that end a word where punctuation does not count: all ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (one offset more than texts). A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of up to `most` bytes, or one longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """The words of some texts: begin, end (bytes), hash, and first: index of each text's first word, one more than texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray, ends_word: np.ndarray = SPACES):
        n = len(data)
        inside = ~ends_word[data]
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            b, e = at[:-1][at[:-1] < n], at[1:][at[1:] > 0] - 1
            begin[b], end[e] = inside[b], inside[e]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.begin, at)
        up = np.full(n + 1, _WORD, np.uint64)
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data] + np.uint64(1)) * up[:n], out=total[1:])
        down = np.full(n + 1, pow(_WORD, -1, 1 << 64), np.uint64)
        down[0] = 1
        np.multiply.accumulate(down, out=down)
        length = (self.end - self.begin).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.begin]) * down[self.begin] + length * _GRAM)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words that follow each other, from every word on that has n-1 words behind it."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + m]) * _GRAM + (out >> np.uint64(29))
    return mix(out)


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, its sorted distinct n-word shingles as uint64). Fewer words: the whole sequence; none: empty."""
    data, at = utf8(column)
    for i, j in slices(at):
        w = Words(data[at[i] : at[j]], at[i : j + 1] - at[i])
        all_grams = grams(w.hash, n)
        for k in range(j - i):
            a, b = w.first[k], w.first[k + 1]
            if b - a >= n:
                yield i + k, np.unique(all_grams[a : b - n + 1])
            elif b > a:
                yield i + k, grams(w.hash[a:b], int(b - a))
            else:
                yield i + k, np.zeros(0, np.uint64)
