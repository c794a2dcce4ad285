"""Document fingerprints: improbable-feature digests.

Every 64-byte window of a text has an entropy.  Windows are ranked by how rare
their entropy is in the corpus (counts in 1001 bins over all texts); a window
that is the rarest among 64 neighbours often enough becomes a feature.  A text
under 1024 bytes, which has few of these, is ranked by its 16-byte windows too
(counted apart, over the texts of that length).  Features go, in order, into a chain of 2048-bit Bloom filters with five bits
each and ``PER_FILTER`` features at most.  Likeness of two digests: for each
filter of the shorter chain the best overlap with the other chain's filters,
less the overlap that chance gives, averaged.

Defined cases: a null text is an empty one; an empty text has the empty digest,
like itself (1) and unlike all else (0); a text under 16 bytes is one feature;
repeated rows each get their own result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_blocks, mix, partitions, prepare, text_column
from .textops import powers, slices, raw

WINDOW, BINS, BITS, PER_FILTER, LEAST = 64, 1001, 2048, 160, 100
#: Window width of the texts under SHORT bytes.
NARROW, SHORT = 16, 1024
_F = np.concatenate(([0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))))
#: Change of sum c*log2(c) when a byte's count goes to c, in fixed point, so that sums are exact.
_STEP = np.concatenate(([0], np.round(np.diff(_F) * (1 << 20)))).astype(np.int64)


def entropy_bins(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Start and entropy bin (0 to 1000) of every window (WINDOW bytes at most) within a text."""
    n = len(data)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    block = 1 << 18
    for lo in range(0, n, block):
        x = data[lo : lo + block + window]
        m = min(block, n - lo)
        for k in range(1, window):
            same = x[:-k][:m] == x[k:][:m]
            same = same.view(np.uint8)
            ahead[lo : lo + len(same)] += same
            behind[lo + k : lo + k + len(same)] += same
    change = _STEP[behind]
    change[window:] -= _STEP[ahead[: n - window]]
    # the first window's own counts come one by one
    counts = np.zeros(256, np.int64)
    for i in range(window - 1):
        counts[data[i]] += 1
        change[i] = _STEP[counts[data[i]]]
    change[window - 1] = _STEP[behind[window - 1]]
    total = np.cumsum(change)[window - 1 :] / float(1 << 20)
    bins = np.clip(np.round((np.log2(window) - total / window) * (1000 / np.log2(window))), 0, 1000).astype(np.int64)
    last = np.repeat(offsets[1:], np.diff(offsets))[: n - window + 1]
    at = np.flatnonzero(np.arange(n - window + 1) + window <= last)
    return at, bins[at]


def _short(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts under SHORT bytes alone: their bytes, offsets, and each byte's place in ``data``."""
    lengths = np.diff(offsets)
    some = lengths < SHORT
    place = np.flatnonzero(np.repeat(some, lengths))
    return data[place], np.concatenate(([0], np.cumsum(lengths[some]))), place


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """rank[width, bin], 0 the rarest, for both window widths; ties by bin. Bins under LEAST (runs of one byte) come last."""

    def count(batches):
        total = np.zeros(2 * BINS, np.int64)
        for batch in slices(batches):
            data, offsets = raw(batch.column(1))
            total[:BINS] += np.bincount(entropy_bins(data, offsets)[1], minlength=BINS)
            total[BINS:] += np.bincount(entropy_bins(*_short(data, offsets)[:2], NARROW)[1], minlength=BINS)
        return total

    total = count_blocks(docs, count)
    total = (total if len(total) else np.zeros(2 * BINS, np.int64)).reshape(2, BINS)
    rank = np.empty((2, BINS), np.int64)
    for mine, of in zip(rank, total):
        of[:LEAST] += of.max() + 1
        mine[np.argsort(of, kind="stable")] = np.arange(BINS)
    return rank


def _selected(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that are the rarest of ``window`` neighbours a quarter of the time, in texts without any such: once."""
    at, bins = entropy_bins(data, offsets, window)
    if not len(at):
        return at
    n, texts = len(data), len(offsets) - 1
    size = -(-(n + window) // window) * window
    value = np.full(size, np.int64(1) << 60)
    value[at] = (rank[bins] << 40) | at
    blocks = value.reshape(-1, window)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[at], left[np.minimum(at + window - 1, size - 1)]) & ((1 << 40) - 1)
    score = np.bincount(best, minlength=n)
    doc_of = np.repeat(np.arange(texts), np.diff(offsets))
    picked = np.flatnonzero(score >= window // 4)
    some = np.zeros(texts, bool)
    some[doc_of[picked]] = True
    weak = np.flatnonzero(score > 0)
    return np.concatenate((picked, weak[~some[doc_of[weak]]]))


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and 64-bit hash of each selected feature, in order of place."""
    n, lengths = len(data), np.diff(offsets)
    tiny = np.flatnonzero((lengths > 0) & (lengths < NARROW))
    wide = _selected(data, offsets, rank[0], WINDOW)
    some, bounds, place = _short(data, offsets)
    narrow = place[_selected(some, bounds, rank[1], NARROW)]
    starts = np.concatenate((offsets[tiny], wide, narrow))
    spans = np.concatenate((lengths[tiny], np.full(len(wide), WINDOW), np.full(len(narrow), NARROW)))
    order = np.argsort(starts, kind="stable")
    starts, spans = starts[order], spans[order]
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = mix((sums[starts + spans] - sums[starts]) * inverse[starts] + spans.astype(np.uint64))
    return np.searchsorted(offsets, starts, "right") - 1, h


def digests(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """For each text its chain of filters, as a (filters, BITS / 8) array of bytes."""
    texts = len(offsets) - 1
    doc, h = features(data, offsets, rank)
    first = np.searchsorted(doc, np.arange(texts + 1))
    per = np.diff(first)
    n_filters = -(-per // PER_FILTER)
    base = np.cumsum(n_filters) - n_filters
    link = base[doc] + (np.arange(len(doc)) - first[doc]) // PER_FILTER
    field = np.zeros((int(n_filters.sum()), BITS), np.uint8)
    for k in range(5):
        field[link, (h >> np.uint64(11 * k)).astype(np.int64) % BITS] = 1
    packed = np.packbits(field, axis=1)
    return [packed[b : b + m] for b, m in zip(base, n_filters)]


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def decode(digest: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(digest), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal digests, 0 if only one of them is empty."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    pa_, pb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    total = 0.0
    for x, px in zip(a, pa_):
        both = np.bitwise_count(x & b).sum(1).astype(float)
        chance = px * pb / BITS
        least = np.minimum(px, pb)
        total += float(np.clip((both - chance) / np.maximum(least - chance, 1e-9), 0, 1).max())
    return total / len(a)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text."""
    prepare(docs.sparkSession)
    docs = text_column(docs)
    rank = docs.sparkSession.sparkContext.broadcast(entropy_ranks(docs))

    def each(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(x) for x in digests(*raw(batch.column(1)), rank.value)], pa.string())], ["doc_id", "fingerprint"])

    return docs.mapInArrow(each, "doc_id long, fingerprint string")


MAX_RANGES = 2048


def in_order(docs: DataFrame) -> DataFrame:
    """Rows by descending doc_id (null last) in contiguous ranges: columns r (range), ahead (0 own, 1 the next range's first row), doc_id, text.

    Each range also gets the first row of the range after it (the last: of the
    first), so a task sees every row's successor without another task's help.
    """
    spark = docs.sparkSession
    n = min(MAX_RANGES, max(2, partitions(spark)))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    keyed = docs.withColumn("k", key)
    cuts = sorted({int(x) for x in keyed.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)})
    if cuts:
        grid = F.array(*[F.lit(c).cast("long") for c in cuts])
        keyed = keyed.withColumn("r", F.size(F.filter(grid, lambda c: c >= F.col("k"))))
    else:
        keyed = keyed.withColumn("r", F.lit(0))
    tops = sorted((r["r"], r["k"]) for r in keyed.groupBy("r").agg(F.max("k").alias("k")).collect())
    if not tops:
        return keyed.select("r", F.lit(0).alias("ahead"), "doc_id", "text")
    heads = []
    for i, (r, _) in enumerate(tops):
        heads += [F.lit(tops[(i + 1) % len(tops)][1]).cast("long"), F.lit(r)]
    head_of = F.element_at(F.create_map(*heads), F.col("k"))
    copies = F.array_compact(F.array(F.struct(F.col("r").alias("r"), F.lit(0).alias("ahead")), F.when(head_of.isNotNull(), F.struct(head_of.alias("r"), F.lit(1).alias("ahead")))))
    dealt = keyed.select("k", "doc_id", "text", F.explode(copies).alias("to")).select("to.r", "to.ahead", "k", "doc_id", "text")
    return dealt.repartition(n, "r").sortWithinPartitions("r", "ahead", F.desc("k"), "text").select("r", "ahead", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last third replaced by the start of the next document, by descending doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    docs = text_column(docs)
    rank = spark.sparkContext.broadcast(entropy_ranks(docs))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def chains(texts: list[str]) -> list[np.ndarray]:
        out = []
        held, size = [], 0
        for t in [*texts, None]:
            if held and (t is None or size + len(t) > 2 << 20):
                out += digests(*raw(pa.array(held, pa.large_string())), rank.value)
                held, size = [], 0
            if t is not None:
                held.append(t)
                size += len(t)
        return out

    def work(ids, texts, after):
        """Results for ``texts``, each followed by the next; ``after`` follows the last."""
        follow = [*texts[1:], after]
        edits = []
        for t, u in zip(texts, follow):
            k = len(t) // 3
            edits.append(t[: len(t) - k] + u[:k])
        own = chains([*texts, after])
        new = chains(edits)
        cols = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edits], [encode(x) for x in own[:-1]], [encode(x) for x in new], [likeness(a, b) for a, b in zip(own, new)], [likeness(a, b) for a, b in zip(own, own[1:])]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def each(batches):
        now, ids, texts, size = None, [], [], 0
        for batch in slices(batches, "text", 8 << 20):
            for r, ahead, i, t in zip(*[c.to_pylist() for c in batch.columns]):
                t = t or ""
                if r != now:
                    if texts:  # several rows stood first in the next range: only the first follows
                        raise AssertionError("a range without a row ahead")
                    now, ids, texts, size = r, [], [], 0
                    closed = False
                if ahead:
                    if not closed:
                        yield work(ids, texts, t)
                        ids, texts, size, closed = [], [], 0, True
                    continue
                if size > 4 << 20:
                    yield work(ids, texts, t)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)

    return in_order(docs).mapInArrow(each, schema)
