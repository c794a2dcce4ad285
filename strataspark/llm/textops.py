"""Vectorised words and word windows over Arrow string columns.

A word is a longest run of bytes other than space and 0x09-0x0D, which for
UTF-8 is ``[^\\x20\\x09-\\x0D]+``.  Hashes are 64-bit: a polynomial over the
bytes by prefix sums, then mixed; windows of words are hashed from word hashes
in the same way, so a window costs the same at any width.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SLICE_BYTES, mix

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE_BYTES + 1
    while size < n:
        size *= 2
    return _powers(size)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, in slices of about ``limit`` bytes of text at most (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (one more than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a slice of texts: byte ``starts`` and ``ends``, text index ``doc``, 64-bit ``hash``; ``first[d]:first[d+1]`` are those of text d."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashed: bool = True):
        data, self.offsets = raw(texts)
        self.data = data
        self.n = len(self.offsets) - 1
        solid = ~SPACE[data]
        if len(data):
            begin = solid.copy()
            begin[1:] &= ~solid[:-1]
            stop = solid.copy()
            stop[:-1] &= ~solid[1:]
            edges = self.offsets[:-1][self.offsets[:-1] < len(data)]
            begin[edges] = solid[edges]
            last = edges[edges > 0] - 1
            stop[last] = solid[last]
            self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)
        self.hash = self._hashes(LOWER[data] if lower else data) if hashed else None

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        power, inverse = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each run of k words within a text."""
        return windows_of(self.hash, self.doc, k)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def windows_of(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    at = np.flatnonzero(doc[k - 1 :] == doc[: n - k + 1])
    return at, mix((sums[at + k] - sums[at]) * inverse[at] + np.uint64(k))


def joined(w: Words, d: int, keep: np.ndarray | None = None) -> bytes:
    """The words of text d (those that ``keep`` marks), joined by one space."""
    lo, hi = w.first[d], w.first[d + 1]
    return glued(w.data, w.starts[lo:hi], w.ends[lo:hi], keep)


def glued(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> bytes:
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return b""
    lengths = ends - starts + 1
    total = int(lengths.sum()) - 1
    shift = starts - (np.cumsum(lengths) - lengths)
    at = np.repeat(shift, lengths)[:total] + np.arange(total)
    out = data[np.minimum(at, len(data) - 1)]
    out[np.cumsum(lengths)[:-1] - 1] = 32
    return out.tobytes()
