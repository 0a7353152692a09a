"""Numpy helpers that work on the UTF-8 bytes of an Arrow batch of texts.

Each function sees one bounded piece of a batch (whole texts, a quarter of a megabyte
together unless one text alone is longer), so memory in a Python worker does
not depend on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLD = _LOWER.copy()
_FOLD[[x for x in range(33, 127) if not chr(x).isalnum()]] = 0x20
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
TOP = np.iinfo(U).max


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(_MULTIPLIERS[0])
    x = x ^ (x >> U(27))
    x = x * U(_MULTIPLIERS[1])
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[e] - sums[s], times the inverse power of s, is the polynomial hash of data[s:e]."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data))[0], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((sums[e] - sums[s]) * powers(len(sums))[1][s] + (e - s).astype(U))


def text_pieces(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = texts.cast(pa.large_string()).fill_null("") if not pa.types.is_large_binary(texts.type) else texts.fill_null(b"")
    n = len(arr)
    if not n:
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


@dataclass
class Words:
    """The words of the texts in rows first..end: bytes start..end, the row counted from first, a 64-bit hash."""

    first: int
    end: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray

    def word_offsets(self) -> np.ndarray:
        return np.searchsorted(self.row, np.arange(self.end - self.first + 1))


def words(texts: pa.Array, lower: bool = False, fold: bool = False) -> Iterator[Words]:
    """Words between white space; lower lowers A-Z, fold also takes ASCII punctuation for white space."""
    for first, end, data, off in text_pieces(texts):
        if lower or fold:
            data = (_FOLD if fold else _LOWER)[data]
        n = len(data)
        flag = np.zeros(n + 1, bool)
        solid = ~_SPACE[data]
        starts, ends = solid.copy(), flag
        starts[1:] &= ~solid[:-1]
        ends[1:n] = solid[: n - 1] & ~solid[1:]
        if n:
            ends[n] = solid[n - 1]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        starts[cut] = solid[cut]
        ends[cut] |= solid[cut - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends)
        row = np.searchsorted(off, s, "right") - 1
        yield Words(first, end, data, off, s, e, row, range_hash(prefix_sums(data), s, e))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n hashes from each position on; the last n - 1 positions are left out."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, U)
    for j in range(n):
        out = out * U(_BASE) + hashes[j : j + m]
    return mix(out)


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many values, the position of its leftmost least one, by the upper 40 bits."""
    n, low = len(values), U((1 << 24) - 1)
    if n <= 1 << 24:
        least, size = (values & ~low) | np.arange(n, dtype=U), 1
        while size < width:
            step = min(size, width - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        return (least & low).astype(np.int64)
    values, at, size = values >> U(24), np.arange(n), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at, size = np.where(values[a] <= values[b], a, b), size + step
    return at


def same_row(row: np.ndarray, n: int) -> np.ndarray:
    """Whether the n items from each position on lie in one row."""
    m = max(0, len(row) - n + 1)
    return row[:m] == row[n - 1 : n - 1 + m]


def distinct_pairs(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(row):
        return row, values
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    return row[new], values[new]


def spread(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items some range [start, start + width) covers."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + width, n), -1)
    return np.cumsum(edges[:n]) > 0


def in_sets(row: np.ndarray, values: np.ndarray, set_row: np.ndarray, set_values: np.ndarray) -> np.ndarray:
    """Whether each (row, value) is among the given ones."""
    if not len(row) or not len(set_row):
        return np.zeros(len(row), bool)
    salt = mix(mix(np.arange(max(int(row.max()), int(set_row.max())) + 1, dtype=U) + U(1 << 40)))
    return np.isin(values ^ salt[row], set_values ^ salt[set_row])


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every item of a column of lists of longs; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, U)
    import pyarrow.compute as pc

    counts = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    return np.repeat(np.arange(len(column)), counts), values
