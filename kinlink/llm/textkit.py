"""Vectorised words of many texts at once: NumPy over the UTF-8 bytes of an Arrow column.

Words are found and hashed without a Python object for each word.  Work goes over bounded pieces of the bytes, so memory
follows the batch of texts (or the longest text), not the table.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_libc = next((x for x in [ctypes.CDLL(ctypes.util.find_library("c") or None)] if hasattr(x, "malloc_trim")), None)
#: Odd multipliers of the polynomial hashes, and those of the final mix (fixed values).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bytes and words hashed in one piece.
PIECE = 1 << 17

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word under the two definitions in use: anything but white space; letters, digits and all non-ASCII.
NON_BLANK = ~BLANK
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below at least n; kept for later calls up to a fixed length."""
    size = PIECE
    while size < n:
        size *= 2
    if (base, size) not in _tables:
        def run(b: int) -> np.ndarray:
            out = np.full(size, b, dtype=U)
            out[0] = 1
            return np.multiply.accumulate(out)

        made = run(base), run(pow(base, -1, 1 << 64))
        if size > 16 * PIECE:
            return made
        _tables[base, size] = made
    return _tables[base, size]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    h = h ^ (h >> U(30))
    h *= U(MIX_A)
    h ^= h >> U(27)
    h *= U(MIX_B)
    h ^= h >> U(31)
    return h


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for spans ordered by start (and by end)."""
    out = np.empty(len(starts), dtype=U)
    k = 0
    while k < len(starts):
        lo = int(starts[k])
        last = int(np.searchsorted(ends[k:], lo + PIECE, side="right")) + k
        last = max(last, k + 1)
        hi = int(ends[last - 1])
        p, inv = powers(base, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=U)
        np.cumsum(values[lo:hi].astype(U, copy=False) * p[: hi - lo], out=sums[1:])
        s = starts[k:last] - lo
        out[k:last] = (sums[ends[k:last] - lo] - sums[s]) * inv[s]
        k = last
    return out


class Words:
    """Words of a batch of texts.

    start, end: byte range of each word in ``buf``; first: index of each text's first word, and at the end the number of
    words; hash: 64-bit hash of each word; n: words of each text.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool = False):
        if lower:
            buf = LOWER[buf]
        self.buf, self.offs = buf, offs
        inside = table[buf]
        begins, stops = np.zeros(len(buf) + 1, dtype=bool), np.zeros(len(buf) + 1, dtype=bool)
        if len(buf):
            begins[:-1] = inside
            begins[1:-1] &= ~inside[:-1]
            stops[1:] = inside
            stops[1:-1] &= ~inside[1:]
            edge = offs[1:-1]
            edge = edge[(edge > 0) & (edge < len(buf))]
            cutting = edge[inside[edge] & inside[edge - 1]]  # texts lie next to each other
            begins[cutting] = True
            stops[cutting] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops)
        self.first = np.searchsorted(self.start, offs)
        self.n = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            raw = span_hash(self.buf, self.start, self.end, BYTE_BASE)
            self._hash = mix(raw + (self.end - self.start).astype(U) * U(WORD_BASE))
        return self._hash

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def fits(self, size: int) -> np.ndarray:
        """Mask of the words at which ``size`` words of one text begin."""
        return np.arange(len(self.start)) <= np.repeat(self.first[1:] - size, self.n)

    def window_hash(self, at: np.ndarray, size: int) -> np.ndarray:
        return mix(span_hash(self.hash, at, at + size, WORD_BASE) + U(size))


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column (null: empty) and the offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    kind = pa.large_binary() if col.type in (pa.large_string(), pa.large_binary()) else pa.binary()
    if col.type not in (pa.binary(), pa.large_binary()):
        col = col.cast(pa.binary() if kind == pa.binary() else kind)
    if col.null_count:
        col = col.fill_null(b"")
    width = np.int64 if kind == pa.large_binary() else np.int32
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=width)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return buf, o - o[0]


def pieces(col: pa.Array, budget: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``budget`` bytes (one longer text stands alone): first row, end, bytes, offsets."""
    buf, offs = column_bytes(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + budget, side="right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def cover(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Mask of the positions below n that lie in any of the ranges."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(d[:-1]) > 0


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... (n[0] of them), lo[1], ..."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    skip = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return np.arange(total) + skip


def _release() -> None:
    """Give free memory back to the system: workers outlive their tasks, and idle ones share an executor with the next stage."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def frugal(run: Callable) -> Callable:
    """``run`` (of ``mapInArrow`` or ``applyInArrow``), which then gives free memory back: at the end of a task, or after each group."""
    if inspect.isgeneratorfunction(run):
        def of_batches(batches):
            yield from run(batches)
            _release()

        return of_batches

    def of_group(*args):
        out = run(*args)
        _release()
        return out

    # Spark goes by the number of arguments
    return {1: lambda t: of_group(t), 2: lambda k, t: of_group(k, t), 3: lambda k, t, a: of_group(k, t, a)}[len(inspect.signature(run).parameters)]


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
