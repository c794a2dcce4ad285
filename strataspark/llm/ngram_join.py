"""N-gram Jaccard join of documents, and the components that its links make.

1. Rarity: counts of shingles in a fixed number of slots over all documents;
   a set's elements carry their rarity class in the top bits, so a sorted set
   is in rare-first order.
2. Equal sets become one node (grouped with map-side combining); only nodes are joined.
3. Prefix filter: a node sends its first n - ceil(t n) + 1 elements to
   partitions by element.  Nodes that share one are candidates if the length
   and the positional filter let them pass.
4. Runs of few nodes give all their pairs.  In a longer run, a group of near
   copies as a rule, each node is first paired with one or two of the run's
   first nodes in the order of a hash; after those are verified and joined into
   components, two, then sixteen, then all pairs follow for each node of the run
   with nodes that are still in other components.
   So no link between different components is lost, and a group of copies costs
   a few pairs a node, not all pairs.
5. Each candidate pair is verified once, on whole sets, if a parity map of two
   bits an element and the suffix filter (element counts by hash range) allow a
   link: both bound the sets' difference from below.

Thresholds are exact: two sets link when 100 * common >= percent * union.

Defined cases: texts without words have empty sets, linked with nothing; rows
with a null doc_id are scored but linked with nothing (component null); rows
that share a doc_id are judged each by its own text; equal texts share a component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_of, count_blocks, dealt, drop, id_filter, may_hold, mix, pack, prepare, release, runs, spread, text_column, unpack, written
from .components import components
from .textops import Words, powers, slices

SLOT_BITS = 20
CLASS_BITS = 6
SMALL_RUN = 8
#: Members of a long run that the others are tried with first, and how many pairs of these each member takes.
HUBS, HUB_PAIRS = 4, 2
BUCKET_ENTRIES = 1 << 20
LEAST_BUCKETS = 64
#: A run's nodes in one task at most; beyond, the run is split by node and tied together by every SPLIT / 64-th node.
#: A slot of the counts holds many elements, so what it has over twice the mean slot is taken for one element's.
SPLIT = 1 << 16
#: Members of an open run that meet in one task; a longer run is cut into blocks, and every two of them meet.
RUN_BLOCK = 512


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words (of all its words, if fewer)."""
    w = Words(texts, lower=True)
    at, h = w.windows(k)
    first = np.searchsorted(w.doc[at], np.arange(w.n + 1)) if len(at) else np.zeros(w.n + 1, np.int64)
    out = []
    for d in range(w.n):
        if first[d + 1] > first[d]:
            x = np.sort(h[first[d] : first[d + 1]])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif w.counts[d]:
            own = w.hash[w.first[d] : w.first[d + 1]]
            power, _ = powers(len(own))
            out.append(mix((own * power[: len(own)]).sum(keepdims=True) + np.uint64(len(own))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def rarity_classes(counts: np.ndarray) -> np.ndarray:
    """0 (rarest) to 2^CLASS_BITS - 1 by slot: four steps per doubling of the slot's count over the mean."""
    mean = max(1.0, counts.mean()) if len(counts) else 1.0
    return np.clip(np.ceil(4 * np.log2(np.maximum(counts, 1) / mean)), 0, (1 << CLASS_BITS) - 1).astype(np.uint64)


def ranked(x: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set's elements with their class on top, sorted: rare first."""
    slot = (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return np.sort((classes[slot] << np.uint64(64 - CLASS_BITS)) | (x >> np.uint64(CLASS_BITS)))


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least common elements of linked sets of sizes a and b."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def passes(na, pa_, nb, pb, percent: int) -> np.ndarray:
    """Length and positional filter for sets that share an element at places pa_ and pb."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    room = 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (100 * small >= percent * large) & (room >= needed(na, nb, percent))


def far_apart(a: np.ndarray, b: np.ndarray, percent: int, ranges: int = 32) -> bool:
    """Suffix filter: counts in ranges of the hash bound the symmetric difference from below."""
    edges = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)
    ca = np.diff(np.concatenate(([0], np.searchsorted(a, edges), [len(a)])))
    cb = np.diff(np.concatenate(([0], np.searchsorted(b, edges), [len(b)])))
    most = len(a) + len(b) - 2 * int(needed(np.int64(len(a)), np.int64(len(b)), percent))
    return int(np.abs(ca - cb).sum()) > most


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b) or far_apart(a, b, percent):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def parity(x: np.ndarray) -> bytes:
    """Parity of the elements in 2n slots or more, a power of two: its bits that differ bound a symmetric difference from below."""
    size = max(256, 1 << (2 * len(x) - 1).bit_length()) if len(x) else 256
    return np.packbits(np.bincount((mix(x) & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, na: int, nb: int, percent: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= na + nb - 2 * int(needed(np.int64(na), np.int64(nb), percent))


def _node(x: np.ndarray) -> int:
    """64-bit digest of a set."""
    if not len(x):
        return 0
    power, _ = powers(len(x))
    return int(mix((x * power[: len(x)]).sum(keepdims=True) + np.uint64(len(x))).view(np.int64)[0])


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(n: np.ndarray, pos: np.ndarray, node: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a run that pass the filters, in blocks. Sorted by n."""
    out_a, out_b = [], []
    m = len(n)
    last = np.searchsorted(n * percent, n * 100, "right")  # sizes rise: who is not too large
    reach = np.minimum(last, m) - np.arange(m) - 1
    lo = 0
    while lo < m:
        hi = lo + max(1, int(np.searchsorted(np.cumsum(reach[lo:]), 1 << 20, "right")))
        a = np.repeat(np.arange(lo, min(hi, m)), np.maximum(reach[lo:hi], 0))
        b = a + 1 + spread(np.maximum(reach[lo:hi], 0))
        ok = passes(n[a], pos[a], n[b], pos[b], percent)
        out_a.append(node[a[ok]])
        out_b.append(node[b[ok]])
        lo = hi
    return np.concatenate(out_a), np.concatenate(out_b)


def _pair_batch(a: np.ndarray, b: np.ndarray):
    key = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    key = key[key[:, 0] != key[:, 1]]
    for lo in range(0, len(key), 1 << 16):
        part = key[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int32)), pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.int32())], ["kind", "a", "b", "token", "n", "pos"])


CANDIDATES = "kind int, a long, b long, token long, n int, pos int"


def _first_round(percent: int, parts):
    def each(batches):
        for _, rows in buckets_of(batches):
            token, node, n, pos = (np.concatenate(x) for x in zip(*[unpack(r["blob"], np.uint64, np.int64, np.uint32, np.uint32) for r in rows]))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            order = np.argsort(token, kind="stable")
            start, length = runs(token[order])
            # of a run that is split, what is here must be kept for the second round whatever its length
            split = parts.value[slot_of(token[order[start]])] > 1
            several = (length > 1) | split
            start, length, split = start[several], length[several], split[several]
            if not len(start):
                continue
            keep = order[np.repeat(start, length) + spread(length)]
            token, node, n, pos = token[keep], node[keep], n[keep], pos[keep]
            order = np.lexsort((mix(node.view(np.uint64)), token))
            token, node, n, pos = token[order], node[order], n[order], pos[order]
            start = np.cumsum(length) - length
            out_a, out_b = [], []
            place, of = spread(length), np.repeat(length, length)
            for gap in range(1, SMALL_RUN):  # all pairs of short runs
                i = np.flatnonzero((place + gap < of) & (of <= SMALL_RUN))
                ok = passes(n[i], pos[i], n[i + gap], pos[i + gap], percent)
                out_a.append(node[i[ok]])
                out_b.append(node[i[ok] + gap])
            long = (length > SMALL_RUN) | split
            if long.any():
                # members in order of a hash: the first ones are the same in many runs, so few different pairs arise
                i = np.repeat(start[long], length[long]) + spread(length[long])
                head, size = np.repeat(start[long], length[long]), np.repeat(length[long], length[long])
                left = np.full(len(i), HUB_PAIRS)
                for h in range(HUBS):
                    hub = np.minimum(head + h, head + size - 1)
                    ok = (left > 0) & (i > hub) & (h < size) & passes(n[i], pos[i], n[hub], pos[hub], percent)
                    out_a.append(node[i[ok]])
                    out_b.append(node[hub[ok]])
                    left[ok] -= 1
                for lo in range(0, len(i), 1 << 16):
                    j = i[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(j), np.int32)), pa.array(node[j]), pa.nulls(len(j), pa.int64()), pa.array(token[j].view(np.int64)), pa.array(n[j].astype(np.int32)), pa.array(pos[j].astype(np.int32))], ["kind", "a", "b", "token", "n", "pos"])
            yield from _pair_batch(np.concatenate(out_a), np.concatenate(out_b))

    return each


def _second_round(percent: int, most: int | None):
    """Rows of long runs (or of two blocks of one) sorted by their key, with components -> the pairs between components, or for each member ``most`` of them."""

    def flush(parts):
        node, n, pos, root, block = (np.concatenate(x) for x in zip(*parts))
        if len(np.unique(root)) < 2:
            return
        order = np.lexsort((node, n))
        node, n, pos, root, block = node[order], n[order].astype(np.int64), pos[order].astype(np.int64), root[order], block[order]
        a, b = _pairs(n, pos, np.arange(len(node)), percent)
        apart = (root[a] != root[b]) & ((block[a] != block[b]) | (block[0] == block[-1]) & (block == block[0]).all())
        a, b = a[apart], b[apart]
        if most is not None and len(a):
            a, b = np.concatenate((a, b)), np.concatenate((b, a))
            order = np.lexsort((mix((node[a] ^ node[b]).view(np.uint64)), a))
            a, b = a[order], b[order]
            _, m = runs(a)
            keep = spread(m) < most
            a, b = a[keep], b[keep]
        yield from _pair_batch(node[a], node[b])

    def each(batches):
        now, parts = None, []
        for batch in batches:
            token = batch.column(0).to_numpy()
            cols = [batch.column(k).to_numpy() for k in range(1, 6)]
            for s, m in zip(*runs(token)):
                if token[s] != now:
                    if parts:
                        yield from flush(parts)
                    now, parts = token[s], []
                parts.append([c[s : s + m] for c in cols])
        if parts:
            yield from flush(parts)

    return each


def _counter(k: int):
    def count(batches):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), k)
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
        return total

    return count


def slot_of(token: np.ndarray) -> np.ndarray:
    """The count slot of ranked elements."""
    return ((token << np.uint64(CLASS_BITS)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class NgramJoin:
    """The join's parts: ``nodes`` (node, doc_id, n: the smallest doc_id of each set), ``members`` (doc_id, n, node) and ``links()`` between nodes."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        prepare(self.spark)
        self.docs = text_column(docs)
        counts = count_blocks(self.docs, _counter(k))
        counts = counts if len(counts) else np.zeros(1 << SLOT_BITS, np.int64)
        self.classes = self.spark.sparkContext.broadcast(rarity_classes(counts))
        over = np.maximum(counts - 2 * int(counts.mean()), 0) if len(counts) else counts
        self.parts = self.spark.sparkContext.broadcast(np.clip(-(-over // SPLIT), 1, 1 << 20).astype(np.uint32))
        self.sets = written(self.docs.mapInArrow(self._sets(), "doc_id long, n long, node long, prefix binary, parity binary"), "sets")
        self.members = written(self.sets.select("doc_id", "n", "node"), "members")
        nodes = self.sets.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
        self.nodes = written(nodes, "nodes")
        drop(self.sets)
        release(self.spark)

    def _sets(self):
        k, percent, classes = self.k, self.percent, self.classes

        def each(batches):
            for batch in slices(batches):
                n, node, prefix, sign = [], [], [], []
                for x in shingle_sets(batch.column(1), k):
                    x = ranked(x, classes.value)
                    n.append(len(x))
                    node.append(_node(x))
                    prefix.append(x[: prefix_length(len(x), percent)].tobytes())
                    sign.append(parity(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(prefix, pa.binary()), pa.array(sign, pa.binary())], ["doc_id", "n", "node", "prefix", "parity"])

        return each

    def _entries(self, n_buckets: int):
        parts = self.parts

        def each(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    blobs = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                    lengths = np.array([len(x) for x in blobs])
                    token = np.concatenate(blobs)
                    node = np.repeat(part.column(0).to_numpy(), lengths)
                    n = np.repeat(part.column(1).to_numpy(), lengths).astype(np.uint32)
                    pos = spread(lengths).astype(np.uint32)
                    place = mix(token)
                    split = parts.value[slot_of(token)].astype(np.uint64)
                    wide = split > 1
                    if wide.any():
                        own = mix(node.view(np.uint64))
                        tail = np.where(wide, own % np.maximum(split, np.uint64(1)) + np.uint64(1), np.uint64(0))
                        pilot = wide & (own % (np.uint64(8) * np.maximum(split, np.uint64(1))) == 0)
                        token, node, n, pos, place = (np.concatenate((x, x[pilot])) for x in (token, node, n, pos, place))
                        place = mix(place + np.concatenate((tail, np.full(int(pilot.sum()), 1 << 21, np.uint64))))
                    bucket = (place % np.uint64(n_buckets)).astype(np.int32)
                    order = np.lexsort((token, bucket))
                    s, m = runs(bucket[order])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[order[s]]), pa.array([pack(token[o], node[o], n[o], pos[o]) for o in (order[a : a + b] for a, b in zip(s, m))], pa.binary())], ["b", "blob"])

        return each

    def _fetch(self, wanted: np.ndarray) -> DataFrame:
        """(node, elements) of the documents in the filter."""
        k, classes = self.k, self.classes
        field = self.spark.sparkContext.broadcast(wanted)

        def each(batches):
            for batch in slices(batches):
                ids = _ids(batch.column(1))
                keep = np.flatnonzero(may_hold(field.value, ids))
                if not len(keep):
                    continue
                part = batch.take(pa.array(keep))
                sets = {_node(x): x for x in (ranked(x, classes.value) for x in shingle_sets(part.column(0), k)) if len(x)}
                # back to hash order, in which the suffix filter's ranges are even
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([np.sort(x << np.uint64(CLASS_BITS) | x >> np.uint64(64 - CLASS_BITS)).tobytes() for x in sets.values()], pa.binary())], ["node", "elements"])

        return self.docs.select("text", "doc_id").mapInArrow(each, "node long, elements binary")

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose parity maps allow a link, with all their columns."""
        percent, names = self.percent, pairs.columns
        end = lambda k: self.nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"p_{k}")).hint("merge")
        met = pairs.hint("merge").join(end("a"), "a").hint("merge").join(end("b"), "b").select(*names, "n_a", "n_b", "p_a", "p_b")

        def each(batches):
            for batch in batches:
                k = batch.num_columns - 4
                na, nb, x, y = (c.to_pylist() for c in batch.columns[k:])
                keep = pa.array([may_link(*v, percent) for v in zip(x, y, na, nb)], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:k]], names)

        return written(met.mapInArrow(each, pairs.schema), "possible")

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        """(node, elements) of the ends of the pairs."""
        ends = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(self.nodes.select("node", "doc_id"), "node"), "ends")
        # the filter lets a few sets more pass, which no pair asks for; rows that repeat under one doc_id are thinned out
        n = ends.count()
        sets = written(self._fetch(id_filter(ends, "doc_id", n)), "elements")
        if sets.count() > 1.1 * n + 1000:
            sets = written(sets.dropDuplicates(["node"]), "elements")
        drop(ends)
        return sets

    def _verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The linked ones of the distinct pairs (a, b)."""
        percent = self.percent
        field = self.spark.sparkContext.broadcast(id_filter(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), n=2 * pairs.count()))

        def needed_here(batches):
            for batch in batches:
                yield batch.filter(pa.array(may_hold(field.value, batch.column(0).to_numpy())))

        sets = sets.mapInArrow(needed_here, "node long, elements binary")
        left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))

        def each(batches):
            for batch in batches:
                a, b = batch.column(0), batch.column(1)
                ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

        # a sort-merge join at any size: sets are never broadcast
        met = pairs.select("a", "b").hint("merge").join(left.hint("merge"), "a").hint("merge").join(right.hint("merge"), "b").select("a", "b", "x", "y")
        found = written(met.mapInArrow(each, "a long, b long"), "links")
        release(self.spark)
        return found

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Verified links (a, b) between nodes, enough to connect all that are linked, and their components (node, root).

        Candidates are verified in three steps: each node's best partner (that
        it met in most runs), the best of those that are left between
        components, and all that are then left between components.
        """
        total = self.nodes.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
        n = max(LEAST_BUCKETS, math.ceil(total / BUCKET_ENTRIES))
        entries = self.nodes.select("node", "n", "prefix").mapInArrow(self._entries(n), "b int, blob binary")
        found = written(dealt(entries, n).mapInArrow(_first_round(self.percent, self.parts), CANDIDATES), "candidates")
        release(self.spark)
        pairs = written(found.filter("kind = 0").groupBy("a", "b").agg(F.count("*").alias("w")), "pairs")
        release(self.spark)
        left = self._possible(pairs)
        sets = self._sets_of(left)
        release(self.spark)

        links = roots = None
        for step in range(3):
            if roots is not None:
                left = written(_between(left, roots), "left")
            chosen = left
            if step < 2:
                both = left.select(F.col("a").alias("node"), F.struct("w", F.xxhash64("a", "b").alias("h"), "a", "b").alias("p")).unionByName(left.select(F.col("b").alias("node"), F.struct("w", F.xxhash64("a", "b").alias("h"), "a", "b").alias("p")))
                chosen = written(both.groupBy("node").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct(), "chosen")
            if step and chosen.isEmpty():
                break
            new = self._verify(chosen, sets)
            links = new if links is None else links.unionByName(new)
            drop(roots)
            roots = components(links)
            left = left.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
        long = found.filter("kind = 1").select("token", F.col("a").alias("node"), "n", "pos").distinct()
        long = written(long, "long")
        drop(found, sets)
        done = pairs
        for most in (2, 16, None):
            labelled = long.join(roots, "node", "left").select("token", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
            open_runs = labelled.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / RUN_BLOCK).cast("int").alias("blocks")).filter("lo != hi").select("token", "blocks")
            rest = written(labelled.join(open_runs, "token"), "open")
            if rest.isEmpty():
                break
            # block i of a run meets itself and each other block once, under a key of its own
            own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
            dealt_out = rest.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            dealt_out = dealt_out.withColumn("key", F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")))
            more = dealt_out.select("key", "node", "n", "pos", "root", "block").repartition("key").sortWithinPartitions("key").mapInArrow(_second_round(self.percent, most), CANDIDATES)
            more = written(more.select("a", "b").distinct().join(done.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
            drop(rest)
            if more.isEmpty():
                continue
            possible = self._possible(more)
            if possible.isEmpty():
                done = done.select("a", "b").unionByName(more)
                continue
            sets = self._sets_of(possible)
            new = self._verify(possible, sets)
            drop(sets, possible)
            done = done.select("a", "b").unionByName(more)
            if not new.isEmpty():
                links = links.unionByName(new)
                drop(roots)
                roots = components(links)
        drop(long)
        return links, roots


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.filter("root_a != root_b").select("a", "b", "w")


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    join = NgramJoin(docs, k, percent)
    _, roots = join.links()
    top = join.nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = top.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # the small tables are all that the result rests on
    by_node = written(top.join(least, "root").select("node", "component_id"), "components")
    drop(join.nodes)
    rows = join.members.join(by_node, "node", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
