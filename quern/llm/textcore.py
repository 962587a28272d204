"""Words of whole Arrow text batches as 64-bit hashes, with NumPy and without a Python loop over words.

The hash of a word is a polynomial over its bytes modulo 2^64 with one random 64-bit value per byte, taken from
prefix sums, then finished with a mixing step.  Words are maximal runs of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240611))
RAW = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = RAW.copy()
FOLDED[65:91] = RAW[97:123]
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False
WORDY = np.zeros(256, bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = WORDY[128:] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n, at least; kept for the worker's life."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base)
            np.multiply.accumulate(out, out=out)
            _POWERS[k] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes each; a longer document is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """Words of a run of documents: byte ranges, hashes, and the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True, solid: np.ndarray = NONSPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = solid[data]
        at = offsets[:-1][offsets[:-1] < n]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        begin[at] = solid[at]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)] - 1
        ends[inner] = solid[inner]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(ends) + 1
        forward, back = powers(n + 1)
        total = (FOLDED if fold else RAW)[data]
        total *= forward[:n]
        np.cumsum(total, out=total)
        value = total[self.end - 1]
        before = self.start > 0
        value[before] -= total[self.start[before] - 1]
        value *= back[self.start]
        self.total, self.back = total, back
        self.hash = mix(value + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, offsets)

    def stretch(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of non-empty byte ranges inside words."""
        value = self.total[end - 1]
        before = begin > 0
        value[before] -= self.total[begin[before] - 1]
        value *= self.back[begin]
        return mix(value + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


#: What a worker keeps from one task to the next, by name: dictionaries that are emptied once it begins other work.
KEPT: dict[str, dict] = {}


def let_go(keeps: tuple[str, ...] = ()) -> None:
    """Empties what is in ``KEPT`` under other names than ``keeps``."""
    others = [held for name, held in KEPT.items() if held and name not in keeps]
    for held in others:
        held.clear()
    if others:
        trim()


def trimmed(work, *broadcasts, keeps: tuple[str, ...] = ()):
    """A worker function that hands freed memory back when its task ends: workers live on, and their peaks would add up.

    Values of ``broadcasts`` are let go as well; the next task loads them from the executor's own copy.  Of ``KEPT`` only
    what ``keeps`` names outlives the task's beginning: a worker that has tokenized drops its tokenizer before it scores.
    """

    def run(batches):
        let_go(keeps)
        try:
            yield from work(batches)
        finally:
            for b in broadcasts:
                b.__dict__.pop("_value", None)
            trim()

    return run


def trim() -> None:
    """Hands freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unsigned_crc32(part: bytes | memoryview) -> int:
    import zlib

    return zlib.crc32(part) & 0xFFFFFFFF
