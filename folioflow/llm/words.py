"""Word and shingle hashes of whole batches of texts with numpy, over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are held as numpy arrays at a time.
SLICE_BYTES = 1 << 19

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: list[np.ndarray] = []

#: Blank bytes: space, and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that no letter, digit or non-ASCII character has.
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_R, _RINV):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) of a string column, a few MB at a time; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and for each text the number of its first word (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if fold:
        data = LOWER[data]
    inside = ~blank[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return range_hashes(data, start, end), np.searchsorted(start, offsets)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    raw = (sums[end] - sums[start]) * down[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every run of ``k`` words, and where those of each text begin; a shorter text has one of all its words."""
    n = np.diff(first)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    out = np.empty(at[-1], np.uint64)
    long = n >= k
    if long.any():
        total = max(0, len(words) - k + 1)
        acc = np.full(total, np.uint64(k), np.uint64)
        for j in range(k):
            acc = mix(acc * np.uint64(0xA0761D6478BD642F) + words[j : j + total])
        keep = np.repeat(first[:-1][long] - at[:-1][long], count[long]) + np.flatnonzero(np.repeat(long, count))
        out[np.repeat(long, count)] = acc[keep]
    for c in range(1, k):
        texts = np.flatnonzero(n == c)
        if len(texts):
            acc = np.full(len(texts), np.uint64(c), np.uint64)
            for j in range(c):
                acc = mix(acc * np.uint64(0xA0761D6478BD642F) + words[first[texts] + j])
            out[at[texts]] = acc
    return out, at
