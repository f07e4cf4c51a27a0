"""Vectorised byte-level helpers that run inside Spark tasks (numpy on Arrow data).

Words are maximal runs of bytes other than space and 0x09-0x0D; letters A-Z
count as a-z.  Word and shingle identities are 64-bit hashes: a word is a
polynomial over random per-byte values, a shingle an odd-weighted sum of five
word hashes, finished with an avalanche mix.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
SHINGLE = 5
SEGMENT = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser (splitmix64 constants), wrapping arithmetic on uint64."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(U(seed) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RAW_VALUE = _stream(11, 256)
_LOW_VALUE = _RAW_VALUE[LOWER]
_BASE = U(0x9DDFEA08EB382D69)
_BASE_INV = U(pow(0x9DDFEA08EB382D69, -1, 1 << 64))
_WEIGHTS = _stream(12, SHINGLE + 1) | U(1)
_POW = np.ones(1, U)
_INV = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            size = max(n, SEGMENT + 1)
            out = []
            for base in (_BASE, _BASE_INV):
                p = np.full(size, base, U)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
        _POW, _INV = out
    return _POW[:n], _INV[:n]


class Words:
    """Words of a batch: byte bounds in ``buf``, owning row, hash; rows are contiguous."""

    __slots__ = ("buf", "starts", "ends", "hashes", "first", "n_rows")

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.n_rows = len(texts)
        self.buf = b" ".join(texts) + b" "
        data = np.frombuffer(self.buf, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        row_start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths + 1, out=row_start[1:])
        value = _LOW_VALUE if lower else _RAW_VALUE
        starts, ends, hashes = [], [], []
        lo, n = 0, len(data)
        while lo < n:
            hi = min(lo + SEGMENT, n)
            if hi < n:
                hi = self._cut(data, lo, hi)
            part = data[lo:hi]
            word = np.zeros(len(part) + 2, np.int8)
            word[1:-1] = ~_IS_SPACE[part]
            step = np.diff(word)
            s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            if len(s):
                pw, inv = _powers(len(part) + 1)
                acc = np.zeros(len(part) + 1, U)
                np.cumsum(value[part] * pw[: len(part)], out=acc[1:])
                hashes.append((acc[e] - acc[s]) * inv[s])
                starts.append(s + lo)
                ends.append(e + lo)
            lo = hi
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.starts, self.ends = cat(starts, np.int64), cat(ends, np.int64)
        self.hashes = mix64(cat(hashes, U) + (self.ends - self.starts).astype(U))
        self.first = np.searchsorted(self.starts, row_start)

    @staticmethod
    def _cut(data: np.ndarray, lo: int, hi: int) -> int:
        """A place at or after which no word of [lo, hi) is cut: just after the last space, or the next one."""
        back = np.flatnonzero(_IS_SPACE[data[max(lo, hi - 4096):hi]])
        if len(back):
            return max(lo, hi - 4096) + int(back[-1]) + 1
        while hi < len(data):
            on = np.flatnonzero(_IS_SPACE[data[hi:hi + SEGMENT]])
            if len(on):
                return hi + int(on[0]) + 1
            hi += SEGMENT
        return len(data)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every 5-word window; a row of 1 to 4 words gives one of all its words."""
        h, n = self.hashes, self.counts()
        row = np.repeat(np.arange(self.n_rows), n)
        total = len(h)
        acc = np.zeros(total, U)
        at = np.arange(total) - np.repeat(self.first[:-1], n)
        left = np.repeat(n, n) - at
        for k in range(SHINGLE):
            term = np.zeros(total, U)
            term[: max(0, total - k)] = h[k:] * _WEIGHTS[k]
            acc += np.where(left > k, term, U(0))
        whole = (np.repeat(n, n) < SHINGLE) & (at == 0)
        acc += np.where(whole, np.repeat(n, n).astype(U) * _WEIGHTS[SHINGLE], U(0))
        keep = (left >= SHINGLE) | whole
        return mix64(acc[keep]), row[keep]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later stages, with all that they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: What empties the caches that a worker holds from one task to the next.
EMPTY: list[Callable[[], None]] = []


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20,
           rows: int = 1 << 15, keep: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into runs of rows whose texts hold about ``limit`` bytes (at least one row).

    Caches of a worker's earlier tasks are emptied first, unless they are to be used (``keep``)."""
    if not keep:
        for empty in EMPTY:
            empty()
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.zeros(batch.num_rows + 1, np.int64)
        lengths = pa.compute.binary_length(column.cast(pa.binary())).fill_null(0)
        np.cumsum(lengths.to_numpy(zero_copy_only=False), out=size[1:])
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(size, size[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
            part = batch.slice(lo, hi - lo)
            yield part, texts_of(part.column(part.schema.get_field_index(text)))
            lo = hi
    give_back()


def sorted_sets(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, and the n_rows+1 bounds of the rows."""
    out, first = [], np.searchsorted(rows, np.arange(n_rows + 1))
    counts = np.zeros(n_rows, np.int64)
    for i in range(n_rows):
        own = np.unique(values[first[i]:first[i + 1]])
        counts[i] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate([[0], np.cumsum(counts)])
