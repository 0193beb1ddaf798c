"""Vectorised text kernels over Arrow string buffers: words, rolling hashes, windows. No loop over words or bytes.

A hash of a run of units x[s..e) is sum(code[x[i]] * B**i) * B**-s modulo 2**64, from prefix sums, so that any
window costs one subtraction and one product. The byte codes are random odd words, which keeps structured strings from colliding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Bytes of a text that are hashed at once.
HASH_BYTES = 1 << 21
_U = np.uint64


class Base:
    """Powers of one odd multiplier and of its inverse, kept as far as they were needed."""

    def __init__(self, multiplier: int, seed: int):
        self.b, self.inv = multiplier, pow(multiplier, -1, 2**64)
        self.codes = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            n = max(n, 1 << 16)
            for name, m in (("up", self.b), ("down", self.inv)):
                p = np.full(n + 1, _U(m))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def whole(self, data: np.ndarray) -> np.uint64:
        """The hash of all of a long run of bytes, piece by piece."""
        total = 0
        for at in range(0, len(data), HASH_BYTES):
            part = self.codes[data[at : at + HASH_BYTES]]
            up, _ = self.powers(len(part))
            total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(self.b, at, 2**64)
        return mix(np.array([total % 2**64], np.uint64))[0]

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


#: Two independent hashes; the second one only where 64 bits are too few.
FIRST, SECOND = Base(0x9E3779B97F4A7C15, 1), Base(0xC2B2AE3D27D4EB4F, 2)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the result."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, at, data = col.buffers()
    off = np.frombuffer(at, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def binaries(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column whose row i is raw[off[i] : off[i + 1]]. It is made from its buffers: from a list of memoryviews, Arrow 23 keeps
    a reference to each, and a worker that is used again holds the bytes behind them for good."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with about `limit` bytes of text each; a longer text stands alone. At the end of a task its
    tables and freed memory go back to the system, as an idle worker stays for a while."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            to = min(to, at + rows)
            yield batch.slice(at, to - at)
            at = to
    for base in (FIRST, SECOND):
        base.up = base.down = np.ones(1, np.uint64)
    trim()


def trim() -> None:
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z only."""
    return _LOWER[data]


class Words:
    """start and end of each word in the buffer; row i has the words off[i] up to off[i + 1]."""

    def __init__(self, data: np.ndarray, rows: np.ndarray):
        n = len(data)
        black = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        edge[0] = True
        begins, ends = black.copy(), black
        begins[1:] &= ~black[:-1] | edge[1:n]
        ends = ends.copy()
        ends[:-1] &= ~black[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.off = np.searchsorted(self.start, rows)

    def hashes(self, data: np.ndarray, base: Base = FIRST) -> np.ndarray:
        return hashed(data, self.start, self.end, base)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: Base = FIRST) -> np.ndarray:
    """Hashes of runs of bytes, which follow one another without overlap; some bytes at a time, as the sums take
    many times the bytes they are made from."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(out):
        lo = start[a]
        b = int(np.searchsorted(end, lo + HASH_BYTES, "right"))
        if b <= a:
            out[a], b = base.whole(data[lo : end[a]]), a + 1
        else:
            out[a:b] = base.spans(base.prefix(base.codes[data[lo : end[b - 1]]]), start[a:b] - lo, end[a:b] - lo)
        a = b
    return out


def counts_to_rows(off: np.ndarray) -> np.ndarray:
    """The row of each unit."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def window_starts(off: np.ndarray, length: int) -> np.ndarray:
    """Units at which a window of `length` units of the same row begins."""
    n = int(off[-1])
    if n < length:
        return np.zeros(0, np.int64)
    open_ = np.zeros(n + 1, np.int32)
    size = np.diff(off)
    full = size >= length
    np.add.at(open_, off[:-1][full], 1)
    np.add.at(open_, off[1:][full] - length + 1, -1)
    return np.flatnonzero(np.cumsum(open_[:-1]) > 0)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n units lie in a window that begins at one of the starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
