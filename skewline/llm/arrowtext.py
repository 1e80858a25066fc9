"""Words of Arrow string columns as numpy arrays: no per-word Python objects.

A column's UTF-8 bytes are one contiguous buffer, so word boundaries, word hashes and
shingle hashes of all its texts come from a few passes over that buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once: some tens of MB of arrays in a worker.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_pow = np.ones(1, _U)
_inv = np.ones(1, _U)

# ASCII white space separates words: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        size = max(n, SLICE_BYTES)
        a, b = np.full(size, _BASE, _U), np.full(size, inverse, _U)
        a[0] = b[0] = 1
        _pow, _inv = np.cumprod(a, dtype=_U), np.cumprod(b, dtype=_U)
    return _pow, _inv


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    n = len(col)
    if n == 0:
        return
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    offs = offs - offs[0]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    if offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0]:offs[-1]]
    return data, offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separators, and the first word of each
    text (n + 1 values)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offs[:-1][offs[:-1] < offs[1:]]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[1:][offs[:-1] < offs[1:]] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, _U)
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``k`` words inside a text.  A text of 1 to
    ``k - 1`` words has one shingle: all its words."""
    n = np.diff(first)
    count = np.maximum(n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    before = np.concatenate([[0], np.cumsum(count)])[:-1]
    at = np.arange(len(doc)) - before[doc] + first[:-1][doc]
    out = np.zeros(len(doc), _U)
    stop = first[1:][doc]
    padded = np.concatenate([hashes, np.zeros(k, _U)])
    c = 1
    for j in range(k):
        c = c * 0xD6E8FEB86659FD93 % (1 << 64) | 1
        out += np.where(at + j < stop, padded[at + j], _U(j + 1)) * _U(c)
    return mix(out), doc
