"""Words, shingles and hashes of whole Arrow batches, without a Python loop per word.

Texts of one batch lie in one byte buffer. A slice of that buffer (whole
documents, about a megabyte) is split into words by byte class and hashed with
prefix sums, so memory follows the slice, not the batch. A document longer than
a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: white space of the word definition: the blank and the control characters 9 to 13
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: for words without punctuation: every ASCII character but letters and digits separates
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of them."""
    if len(_tables[0]) >= n:
        return _tables[0], _tables[1]
    made = []
    for base in (BASE, INVERSE):
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    # those of a document longer than a slice are not kept
    if n <= SLICE_BYTES + 1:
        _tables[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most ``limit`` bytes, or one longer document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of the documents ``i..j`` of a batch.

    ``hashes`` holds one hash per word, ``bounds[d] : bounds[d + 1]`` the words
    of document d of the slice, ``starts`` and ``ends`` byte places in ``raw``.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray, i: int, j: int, space: np.ndarray = SPACE):
        base = offs[i]
        self.raw = raw = raw[base : offs[j]]
        self.docs = docs = (offs[i : j + 1] - base).astype(np.int64)
        inside = ~space[raw]
        first, last = inside.copy(), inside.copy()
        if len(raw):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = docs[:-1][docs[:-1] < len(raw)]
            first[edges] = inside[edges]
            edges = docs[1:][docs[1:] > 0] - 1
            last[edges] = inside[edges]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, docs)
        power, inverse = powers(len(raw) + 1)
        values = LOWER[raw].astype(np.uint64)
        values += np.uint64(1)
        values *= power[: len(raw)]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        size = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + size * np.uint64(0xD6E8FEB86659FD93))

    def shingles(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words and their bounds per document.

        A document of fewer than k words gives one hash of its whole sequence
        (with ``short``), a document without words none.
        """
        h, b = self.hashes, self.bounds
        counts = np.diff(b)
        n = len(h)
        rolled = np.zeros(max(n - k + 1, 0), np.uint64)
        for t in range(k):
            rolled += h[t : t + len(rolled)] * np.uint64(pow(BASE, 2 * t + 3, 1 << 64))
        many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64) if short else 0)
        bounds = np.zeros(len(b), np.int64)
        np.cumsum(many, out=bounds[1:])
        out = np.zeros(bounds[-1], np.uint64)
        full = counts >= k
        # word places where a full run starts: all but the last k - 1 of each document
        starts = np.repeat(b[:-1][full], many[full]) + _ramp(many[full])
        out[np.repeat(bounds[:-1][full], many[full]) + _ramp(many[full])] = rolled[starts]
        if short:
            for d in np.flatnonzero((counts > 0) & (counts < k)):
                total = sum(int(h[b[d] + t]) * pow(BASE, 2 * t + 3, 1 << 64) for t in range(counts[d]))
                out[bounds[d]] = np.uint64((total + (k - int(counts[d])) * 0xA24BAED4963EE407) & (1 << 64) - 1)
        return mix(out), bounds


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per document, sorted, with their bounds."""
    h = hashes.copy()
    for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    kept = np.zeros(len(h) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return h[keep], kept[bounds]


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row d holds ``values[bounds[d]:bounds[d + 1]]``."""
    size = values.dtype.itemsize
    offs = (np.asarray(bounds, np.int64) * size).astype(np.int64)
    data = pa.py_buffer(np.ascontiguousarray(values[: bounds[-1]]).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offs.tobytes()), data]).cast(pa.binary())
