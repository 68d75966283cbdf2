"""Vectorised word hashing over Arrow text columns, used inside tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z count as
a-z. A word's hash is a polynomial over random per-byte numbers modulo 2^64, so
one running sum per buffer hashes all words of a batch at once. Two different
words collide with a chance near 2^-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(0x5EED)  # a fixed seed: every task and every run hashes alike
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
TABLE[ord("A") : ord("Z") + 1] = TABLE[ord("a") : ord("z") + 1]
BASE = U(0x9E3779B97F4A7C15)
UNBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEGMENT = 1 << 18  # bytes hashed at a time; bounds the working arrays
_powers: dict[int, np.ndarray] = {}
kept: dict[str, dict] = {}  # by operator: what a worker keeps from task to task


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT + 1), base, U)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift-multiply)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the bounds of its rows; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if n and texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, bounds - (bounds[0] if n else 0)


def _segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut the buffer at white space or row ends into pieces of about ``SEGMENT`` bytes."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + SEGMENT)
        if end < n:
            gaps = np.flatnonzero(SPACE[data[start:end]])
            row = bounds[np.searchsorted(bounds, end, "right") - 1]
            cut = max(start + int(gaps[-1]) + 1 if len(gaps) else start, int(row))
            if cut <= start:  # one word fills the piece: go on to its end
                ahead = np.flatnonzero(SPACE[data[end:]])
                cut = min(end + int(ahead[0]) if len(ahead) else n, int(bounds[np.searchsorted(bounds, end)]))
            end = cut
        yield start, end
        start = end


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a row end also ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    return starts, np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Hash of each span; spans are sorted and do not cross the cuts of ``_segments``."""
    out = np.empty(len(starts), U)
    for a, b in _segments(data, bounds):
        i, j = np.searchsorted(starts, [a, b])
        run = np.empty(b - a + 1, U)
        run[0] = 0
        np.cumsum(table[data[a:b]] * _power(BASE, b - a)[: b - a], out=run[1:])
        s = starts[i:j] - a
        out[i:j] = (run[ends[i:j] - a] - run[s]) * _power(UNBASE, b - a)[s]
    return mix(out)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and per row the bounds of its words."""
    data, bounds = buffers(texts)
    starts, ends = word_spans(data, bounds)
    return hash_spans(data, bounds, starts, ends), np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row and their bounds.

    A row with fewer words than ``size`` has its whole word sequence as its one
    shingle; a row without words has none.
    """
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    if not to[-1]:
        return np.zeros(0, U), to
    at = np.repeat(bounds[:-1] - to[:-1], count) + np.arange(to[-1])
    length = np.repeat(np.minimum(n, size), count)
    h = length.astype(U)
    for k in range(size):
        live = k < length
        h = np.where(live, mix(h * BASE + hashes[np.minimum(at + k, len(hashes) - 1)]), h)
    return h, to


def release() -> None:
    """Give freed memory back, so that a worker that is used again starts small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20, operator: str = "") -> Iterator[pa.RecordBatch]:
    """Record batches of at most about ``limit`` bytes of text, one row at least; freed memory goes back at the end.

    What the worker has kept for operators other than ``operator`` is dropped.
    """
    for name, held in kept.items():
        if name != operator:
            held.clear()
    for batch in batches:
        _, bounds = buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    release()
