"""Vectorised text kernels shared by the operators of this subpackage.

Every kernel works on the UTF-8 buffer of an Arrow string column, so a batch of texts costs a handful of numpy passes
instead of a Python loop over words.  Words are the maximal runs of bytes other than space and the controls 0x09-0x0D;
all of these are ASCII, so splitting bytes and splitting code points gives the same words.

Hashes are polynomial in the ring of 64-bit integers, taken as differences of prefix sums and then mixed.  Null texts
count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; temporaries take some 60 times this.
SLICE_BYTES = 1 << 20

_BYTE_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORD_MULT = np.uint64(0xD6E8FEB86659FD93)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts(NamedTuple):
    """A run of consecutive rows: ``data[offsets[i]:offsets[i + 1]]`` is the text of row ``lo + i``."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte spans of all words of a run; those of row ``i`` are ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of at most ``limit`` bytes (a longer single text makes a run of its own)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield Texts(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(mult: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _powers.get(int(mult))
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = np.uint64(pow(int(mult), -1, 1 << 64))
        made = []
        for m in (mult, inverse):
            p = np.full(size, m, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if size <= 4 * SLICE_BYTES:
            _powers[int(mult)] = (made[0], made[1])
        return made[0], made[1]
    return have


def spans(t: Texts, breaks: np.ndarray) -> Words:
    """Maximal runs of bytes outside the table ``breaks``, never across rows."""
    n = len(t.data)
    stop = breaks[t.data]
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    before[1:] = stop[:-1]
    after[:-1] = stop[1:]
    edges = t.offsets[:-1]
    before[edges[edges < n]] = True
    after[edges[edges > 0] - 1] = True
    start = np.flatnonzero(~stop & before)
    end = np.flatnonzero(~stop & after) + 1
    return Words(start, end, np.searchsorted(start, t.offsets))


def words(t: Texts) -> Words:
    return spans(t, SEPARATOR)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = powers(_BYTE_MULT, len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1 + 257 * seed)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, k: int, mult: np.uint64 = _WORD_MULT) -> np.ndarray:
    """Hash of every ``k`` consecutive entries, regardless of rows; ``len(hashes) - k + 1`` of them."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(mult, n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every window of ``k`` words within one row, and that row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    ahead = np.cumsum(counts) - counts
    return np.arange(len(rows)) - ahead[rows] + first[:-1][rows], rows


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's entries."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
