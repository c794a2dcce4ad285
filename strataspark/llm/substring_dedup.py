"""Substring dedup by prefix-partitioned suffix trees.

Every word position starts a suffix.  Suffixes are split into memory-sized
groups by word prefixes of variable length: the shortest of ``LEVELS`` words
whose group holds at most ``limit`` suffixes.  Group sizes come from counts of
fixed size over all texts.  A group is sorted by its suffixes' first
``width`` words (their 64-bit hash); the runs of equal ones are the subtree's
internal nodes of that depth.  Nodes further down, and so maximal repeats
longer than ``width``, are not built: what is removed rests on that depth
alone.  Two different nodes are mixed up only if their hashes and their
groups' buckets agree: about suffixes * limit / 2^65 pairs.  A node with several documents is a repeat: each of its leaves but
those of the smallest doc_id removes its ``width`` words.  Nodes that alone
exceed ``limit`` (a passage in very many documents) are counted and settled
before the shuffle, from a list whose length is bounded by words / limit.

Defined cases: null and empty texts have no words and stay as they are; texts
of fewer than ``width`` words lose nothing; repeats within one document only
are kept; rows that share a doc_id count as one document.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_blocks, dealt, id_filter, buckets_of, may_hold, mix, pack, prepare, release, runs, spread, text_column, unpack, written
from .textops import Words, glued, slices

LEVELS = (1, 2, 3, 5, 8)
#: Slots of the counts of a prefix length, and of the whole width.
SLOTS, LAST_SLOTS = 1 << 16, 1 << 20


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


def _levels(width: int) -> tuple[int, ...]:
    return tuple(k for k in LEVELS if k < width) + (width,)


def prefix_counts(docs: DataFrame, width: int) -> list[np.ndarray]:
    """For each prefix length, suffixes by the slot of their first words' hash."""
    levels = _levels(width)

    def count(batches):
        total = np.zeros((len(levels) - 1) * SLOTS + LAST_SLOTS, np.int64)
        for batch in slices(batches):
            w = Words(batch.column(1))
            starts, _ = w.windows(width)
            for k, length in enumerate(levels):
                size = SLOTS if length < width else LAST_SLOTS
                total[k * SLOTS : k * SLOTS + size] += np.bincount(_slots(w, length, starts, size), minlength=size)
        return total

    total = count_blocks(docs, count)
    if not len(total):
        total = np.zeros((len(levels) - 1) * SLOTS + LAST_SLOTS, np.int64)
    return [total[k * SLOTS : (k + 1) * SLOTS] for k in range(len(levels) - 1)] + [total[-LAST_SLOTS:]]


def _slots(w: Words, length: int, starts: np.ndarray, size: int) -> np.ndarray:
    at, h = w.windows(length)
    return _slot(h[np.searchsorted(at, starts)], size)


def _slot(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)


def hot_nodes(docs: DataFrame, width: int, counts: np.ndarray, limit: int) -> dict[int, int]:
    """hash -> smallest doc_id of the nodes with over ``limit`` leaves; empty unless a slot of the last level has that many over twice the mean slot."""
    slots = counts > limit + 2 * int(counts.mean())
    if not slots.any():
        return {}

    def each(batches):
        for batch in slices(batches):
            w, ids = Words(batch.column(1)), _ids(batch)
            at, h = w.windows(width)
            hot = slots[_slot(h, LAST_SLOTS)]
            at, h = at[hot], h[hot]
            order = np.lexsort((ids[w.doc[at]], h))
            first, n = runs(h[order])
            yield pa.RecordBatch.from_arrays([pa.array(h[order][first].view(np.int64)), pa.array(ids[w.doc[at]][order][first]), pa.array(n)], ["h", "doc", "n"])

    found = docs.mapInArrow(each, "h long, doc long, n long").groupBy("h").agg(F.min("doc").alias("doc"), F.sum("n").alias("n")).filter(F.col("n") > limit)
    return {r["h"]: r["doc"] for r in found.select("h", "doc").collect()}


def repeated(docs: DataFrame, width: int = 13, limit: int = 1 << 21) -> DataFrame:
    """(doc_id, at array<int>): first words of the windows that also start in a document with a smaller doc_id."""
    spark = docs.sparkSession
    counts = prefix_counts(docs, width)
    total = int(counts[-1].sum())
    hot = hot_nodes(docs, width, counts[-1], limit)
    n_buckets = max(64, 2 * math.ceil(total / limit))
    shared = spark.sparkContext.broadcast(([c > limit for c in counts[:-1]], np.array(sorted(hot), np.int64), np.array([hot[k] for k in sorted(hot)], np.int64)))
    levels = _levels(width)

    def suffixes(batches):
        large, hot_h, hot_doc = shared.value
        for batch in slices(batches, limit=4 << 20):
            w, ids = Words(batch.column(1)), _ids(batch)
            at, h = w.windows(width)
            doc = ids[w.doc[at]]
            pos = (at - w.first[w.doc[at]]).astype(np.uint32)
            if len(hot_h):
                k = np.minimum(np.searchsorted(hot_h, h.view(np.int64)), len(hot_h) - 1)
                known = hot_h[k] == h.view(np.int64)
                late = known & (doc > hot_doc[k])
                if late.any():
                    yield _rows([(-1, pack(doc[late], pos[late]))])
                at, h, doc, pos = at[~known], h[~known], doc[~known], pos[~known]
            group = np.zeros(len(at), np.uint64)
            left = np.arange(len(at))
            for k, length in enumerate(levels):
                if not len(left):
                    break
                if k + 1 == len(levels):  # of the longest prefix each node is a group
                    group[left] = h[left] | np.uint64(1 << 63)
                    break
                slot = _slots(w, length, at[left], SLOTS)
                fits = ~large[k][slot]
                group[left[fits]] = (slot[fits] + k * SLOTS).astype(np.uint64)
                left = left[~fits]
            bucket = (mix(group + np.uint64(1)) % np.uint64(n_buckets)).astype(np.int32)
            order = np.lexsort((h, bucket))
            first, n = runs(bucket[order])
            h, doc, pos = h[order], doc[order], pos[order]
            yield _rows([(int(bucket[order[f]]), pack(h[f : f + m], doc[f : f + m], pos[f : f + m])) for f, m in zip(first, n)])

    def subtrees(batches):
        for b, rows in buckets_of(batches):
            if b < 0:
                for r in rows:
                    yield from _found(*unpack(r["blob"], np.int64, np.uint32))
                continue
            parts = [unpack(r.pop("blob"), np.uint64, np.int64, np.uint32) for r in rows]
            h, doc, pos = (np.concatenate(x) for x in zip(*parts))
            del parts
            order = np.argsort(h, kind="stable")
            h = h[order]
            first, n = runs(h)
            deep = n > 1  # an internal node at full depth
            at = np.repeat(first[deep], n[deep]) + spread(n[deep])
            leaves = order[at]
            doc, pos = doc[leaves], pos[leaves]
            if not len(doc):
                continue
            starts = np.cumsum(n[deep]) - n[deep]
            least = np.repeat(np.minimum.reduceat(doc, starts), n[deep])
            late = doc > least
            yield from _found(doc[late], pos[late])

    blobs = docs.mapInArrow(suffixes, "b int, blob binary")
    found = dealt(blobs, max(1, n_buckets // 2)).mapInArrow(subtrees, "doc_id long, blob binary")
    return written(found, "repeats")


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["b", "blob"])


def _found(doc: np.ndarray, pos: np.ndarray):
    """A row for each document: its window starts, packed."""
    if not len(doc):
        return
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    first, n = runs(doc)
    for lo in range(0, len(first), 5000):
        part = range(lo, min(lo + 5000, len(first)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[first[lo : lo + 5000]]), pa.array([pos[first[k] : first[k] + n[k]].tobytes() for k in part], pa.binary())], ["doc_id", "blob"])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>"


def substring_dedup(docs: DataFrame, width: int = 13, limit: int = 1 << 21, texts: bool = False) -> DataFrame:
    """One row per document: words, removed words, SHA-256 of what is kept, removed word spans (and ``kept_text`` if ``texts``).

    Documents without a repeat are finished where they are read; only the texts
    that a fixed-size filter lets through are shuffled to meet their repeats.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = text_column(docs)
    found = repeated(docs, width, limit)
    release(spark)
    field = spark.sparkContext.broadcast(id_filter(found, "doc_id", found.count()))
    schema = RESULT + (", kept_text string" if texts else "")

    def result(rows):
        cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
        k = 6 if texts else 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds[:k])], names[:k])

    def one(ids_null, doc, w, d, blobs):
        n = int(w.counts[d])
        covered = np.zeros(n + 1, np.int32)
        for blob in blobs:
            at = np.frombuffer(blob, np.uint32)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + width, -1)
        gone = np.cumsum(covered[:n]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        lo, hi = w.first[d], w.first[d + 1]
        kept = glued(w.data, w.starts[lo:hi], w.ends[lo:hi], ~gone)
        spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])]
        return (None if ids_null else doc, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode() if texts else None)

    def untouched(batches):
        for batch in slices(batches):
            keep = np.flatnonzero(~may_hold(field.value, _ids(batch)))
            if len(keep):
                part = batch.take(pa.array(keep))
                w, ids = Words(part.column(1), hashed=False), part.column(0).to_pylist()
                yield result([one(ids[d] is None, ids[d], w, d, ()) for d in range(w.n)])

    def touched(batches):
        for batch in slices(batches):
            keep = np.flatnonzero(may_hold(field.value, _ids(batch)))
            if len(keep):
                yield batch.take(pa.array(keep))

    def cut(batches):
        for batch in slices(batches):
            w, ids = Words(batch.column(1), hashed=False), batch.column(0).to_pylist()
            blobs = batch.column(2).to_pylist()
            yield result([one(ids[d] is None, ids[d], w, d, blobs[d] or ()) for d in range(w.n)])

    plain = docs.mapInArrow(untouched, schema)
    repeats = found.groupBy("doc_id").agg(F.collect_list("blob").alias("blobs"))
    some = docs.mapInArrow(touched, "doc_id long, text string").join(repeats, "doc_id", "left")
    return plain.unionByName(some.select("doc_id", "text", "blobs").mapInArrow(cut, schema))
