"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the raw UTF-8 buffer of an Arrow string column, so a slice of
thousands of documents is split into words and hashed by a few NumPy passes, with no
Python loop over words. Hashes are 64-bit polynomials over a fixed random byte table,
finished by an avalanche step; two seeds together give 128 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised pass holds (with one more place, a power of two); a longer document is a pass of its own.
SLICE_BYTES = (1 << 20) - 1

_U64 = np.uint64


def released(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` for a worker that lives on after its task: what the task no longer uses goes back to the system."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return run


def _separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: True for the bytes that end a word of ``[^\x20\x09-\x0D]+``.
SPACE = _separators(b" \t\n\x0b\x0c\r")
#: True for the bytes that end a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NON_ALNUM = _separators(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _constants(seed: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
    base = int(rng.integers(1, 1 << 62)) * 4 + 3 & (1 << 64) - 1
    return table, _U64(base), _U64(pow(base, -1, 1 << 64))


_SEEDS = {s: _constants(0x5EED + s) for s in (0, 1)}
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= SLICE_BYTES + 1:
            _POWERS[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit moves every output bit."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(27)
    h *= _U64(0x94D049BB133111EB)
    h ^= h >> _U64(31)
    return h


class Texts:
    """A run of documents over one byte buffer; ``offsets`` has one more entry than documents."""

    __slots__ = ("data", "offsets")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def lower(self) -> "Texts":
        return Texts(LOWER[self.data], self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def column_texts(column: pa.Array) -> Texts:
    """The bytes of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, Texts) for consecutive runs of at most ``limit`` bytes, or one longer document."""
    whole = column_texts(column)
    at, n = 0, len(whole)
    while at < n:
        to = max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + limit, "right")) - 1)
        lo, hi = whole.offsets[at], whole.offsets[to]
        yield at, Texts(whole.data[lo:hi], whole.offsets[at : to + 1] - lo)
        at = to


def cut_at(data: np.ndarray, separators: np.ndarray, limit: int = SLICE_BYTES):
    """A long text as consecutive one-document Texts of about ``limit`` bytes, each but the last ending with a separator."""
    at = 0
    while at < len(data):
        to = min(len(data), at + limit)
        while to < len(data):
            blank = np.flatnonzero(separators[data[to : to + limit]])
            to = min(len(data), to + limit) if not len(blank) else to + int(blank[0]) + 1
            if len(blank):
                break
        yield Texts(data[at:to], np.array([0, to - at]))
        at = to


def words(texts: Texts, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more entry)."""
    inside = ~separators[texts.data]
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(texts) + 1, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    full = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    begin[full] = inside[full]
    last = texts.offsets[1:][np.diff(texts.offsets) > 0] - 1
    finish[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, texts.offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each span."""
    table, base, inverse = _SEEDS[seed]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(base, len(data)), out=total[1:])
    # Spans of other lengths never collide on a prefix of zeros: the table has no zero entry.
    return mix((total[ends] - total[starts]) * powers(inverse, len(data) + 1)[starts])


def windows(values: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of values[i:i+size] for every i that has so many; ``values`` are hashes themselves."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    _, base, inverse = _SEEDS[seed]
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    n = len(values) - size + 1
    return mix((total[size:] - total[:n]) * powers(inverse, n))


def byte_windows(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of data[i:i+size] for every i that has so many."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    table, base, inverse = _SEEDS[seed]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(base, len(data)), out=total[1:])
    n = len(data) - size + 1
    return mix((total[size:] - total[:n]) * powers(inverse, n))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every i, the position of the smallest of values[i:i+width] (the leftmost of equals)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    # Blockwise prefix and suffix minima of (value, position); positions follow by comparing values.
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(grid, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    index = np.arange(blocks * width, dtype=np.int64)
    # Position of the prefix minimum: where it was last lowered. Of the suffix minimum: the leftmost place that holds it.
    lowered = np.ones(blocks * width, bool)
    lowered[1:] = prefix[1:] != prefix[:-1]
    lowered[::width] = True
    prefix_at = np.maximum.accumulate(np.where(lowered, index, 0))
    holds = padded == suffix
    suffix_at = np.minimum.accumulate(np.where(holds, index, blocks * width)[::-1])[::-1]
    m = n - width + 1
    left, right = suffix[:m], prefix[width - 1 : width - 1 + m]
    return np.where(left <= right, suffix_at[:m], prefix_at[width - 1 : width - 1 + m])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n places that some [start, end) covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of start .. start+count-1 for each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)
