"""Line dedup by an exact set-similarity join of lines.

A line's set is its distinct lower-cased words.  A line goes if an earlier
line (by doc_id, then line number) has a set with Jaccard similarity of at
least ``percent`` / 100; lines are judged on the input, not on what is left.

1. Word rarity from counts in a fixed number of slots over all texts; elements
   carry their rarity class on top, so sorted sets are rare-first.
2. Slices send each distinct set's first occurrence once: its prefix elements,
   with size, place, a parity map of 64 to 256 bits and the occurrence, to partitions by
   element; and the occurrence to partitions by set.  Later occurrences of a
   set within a slice are settled there, so a line in very many documents costs
   one row a slice.
3. Runs of equal elements give candidates that pass the length, positional and
   parity filters (the parity maps' difference bounds the sets' from below).
   Each later set takes its earliest partners: two at once, a few more in
   reserve for sets that these don't settle.  In long runs the earliest members
   are tried first, so a group of near copies costs a few pairs a member.
4. Pairs are verified on whole sets.  Sets that the reserve leaves open get all
   their candidates in a last exact pass: a few of them meet all texts at once,
   many get their entries dealt again.
5. Rows meet their removed line numbers in a join on their key.

A row's key is its doc_id and, where doc_ids repeat or are null, a digest of its
text: 32 bits that stand above the line number, so a place is (doc, digest and
line); null ids have 30 bits more in place of the id.

Defined cases: lines without words are never removed; null texts stay null;
rows that share a doc_id stand in the order of their digests; equal rows of one
doc_id share their lines' places, none is earlier than the other, so they stay
alike; a null doc_id comes before all others; extra columns are carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_of, count_blocks, dealt, drop, id_filter, may_hold, mix, pack, prepare, release, runs, spread, unpack, written
from .textops import Words, slices

SLOT_BITS, CLASS_BITS, TOKEN_BITS = 20, 5, 47
LEAST_BUCKETS, BUCKET_BYTES = 64, 6 << 20
#: Sets of more words have parity maps of 128 and of 256 bits, smaller ones of 64.
WIDE, VERY_WIDE = 40, 120
FIRST, RESERVE, HUBS, SETTLED, LONG = 2, 48, 20, 14, 64
#: Pairs that are compared at once.
BLOCK_PAIRS = 1 << 18
BROADCAST_DOCS, DIRECT_LINES = 200_000, 1000
NULL_DOC = -(1 << 63)
#: Bits of a place that hold the line number; a digest stands above them.
LINE_BITS = 31
#: Repeated ids that are named one by one; with more, every row has a digest.
NAMED_IDS = 1000


def classes_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(2 * np.log2(np.maximum(counts, 1))) / 2, (1 << CLASS_BITS) - 1).astype(np.uint64)


def tokens_of(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Elements of words: rarity class, then the hash's leading bits."""
    slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return (classes[slot] << np.uint64(TOKEN_BITS - CLASS_BITS)) | (h >> np.uint64(64 - TOKEN_BITS + CLASS_BITS))


def _among(wanted: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted, non-empty ``wanted``."""
    return wanted[np.minimum(np.searchsorted(wanted, x), len(wanted) - 1)] == x


class Lines:
    """Lines with words of a slice: doc index, number in its text, set size, first element, digest, parity map; ``tokens`` sorted by line, rare first."""

    def __init__(self, texts: pa.Array, classes: np.ndarray, sub: np.ndarray):
        w = Words(texts, lower=True)
        newline = np.concatenate(([0], np.cumsum(w.data == 10)))
        number = newline[w.starts] - newline[w.offsets[w.doc]] if len(w.starts) else np.zeros(0, np.int64)
        fresh = np.ones(len(w.starts), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (w.doc[1:] != w.doc[:-1])
        at = np.flatnonzero(fresh)
        self.doc = w.doc[at]
        self.number = number[at].astype(np.int64) + (sub[self.doc] << LINE_BITS)
        line = np.cumsum(fresh) - 1
        token = tokens_of(w.hash, classes)
        if len(at) < 1 << (64 - TOKEN_BITS):
            key = np.sort((line.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token)
            key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
            line, token = (key >> np.uint64(TOKEN_BITS)).astype(np.int64), key & np.uint64((1 << TOKEN_BITS) - 1)
        else:
            order = np.lexsort((token, line))
            line, token = line[order], token[order]
            keep = np.concatenate(([True], (line[1:] != line[:-1]) | (token[1:] != token[:-1])))
            line, token = line[keep], token[keep]
        self.tokens = token
        self.first, self.size = runs(line)
        spread_out = mix(token)
        if len(self.first):
            self.node = mix(np.add.reduceat(spread_out, self.first) + self.size.astype(np.uint64)).view(np.int64)
            # word 0 of the map for small sets, words 0 and 1 for wide, 0 to 3 for very wide ones
            bit, word = np.uint64(1) << (spread_out >> np.uint64(58)), (spread_out >> np.uint64(56)) & np.uint64(3)
            width = np.repeat(np.select([self.size > VERY_WIDE, self.size > WIDE], [np.uint64(3), np.uint64(1)], np.uint64(0)), self.size)
            word &= width
            self.bits = np.stack([np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), self.first) for k in range(4)], 1)
        else:
            self.node, self.bits = np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def keyed(docs: DataFrame) -> tuple[Column, Column]:
    """Row keys of ``docs`` (doc_id long, text string): the place's doc, and the digest where doc_id doesn't tell rows apart, else 0."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = [r[0] for r in ids.limit(NAMED_IDS + 1).collect()]
    digest, null = F.xxhash64("text"), F.col("doc_id").isNull()
    doc = F.when(null, F.lit(NULL_DOC) + F.shiftrightunsigned(digest, 34)).otherwise(F.col("doc_id"))
    several = F.lit(True) if len(repeated) > NAMED_IDS else null | F.col("doc_id").isin(repeated) if repeated else null
    return doc, F.when(several, digest.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.lit(0)).cast("long")


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) + line.astype(np.int64).view(np.uint64)).view(np.int64)


def _late(doc: np.ndarray, line: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Members of runs in order of time whose place isn't the run's first."""
    first = np.repeat(start, length)
    return (doc != doc[first]) | (line != line[first])


def needed(a, b, percent: int):
    return -(-(percent * (a + b)) // (100 + percent))


ENTRY = (np.uint64, np.int64, np.uint32, np.uint32, np.uint64, np.uint64, np.uint64, np.uint64, np.int64, np.int64)
OUT = "kind int, doc long, line long, other_doc long, other_line long, more binary"


def _out(kind: int, doc, line, other_doc=None, other_line=None, more=None) -> pa.RecordBatch:
    n = len(doc)
    none = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(doc, pa.int64()), pa.array(line, pa.int64()), none(other_doc, pa.int64()), none(other_line, pa.int64()), none(more, pa.binary())], ["kind", "doc", "line", "other_doc", "other_line", "more"])


def _slice_rows(classes, percent: int, n_buckets: int, only=None):
    """Entries by element and occurrences by set; with ``only``, just entries whose element it may hold."""

    def blobs(batches):
        for batch in slices(batches, "text", 3 << 20):
            parts, base = [], []
            for piece in slices(iter([batch])):
                x = Lines(piece.column(1), classes.value, _ids(piece.column(2)))
                if len(x.node):
                    doc = _ids(piece.column(0))[x.doc]
                    parts.append((x.node, doc, x.number, x.size, x.bits, x))
                    base.append(len(x.node))
            if not parts:
                continue
            node, doc, line, size, bits = (np.concatenate(c) for c in zip(*[p[:5] for p in parts]))
            order = np.lexsort((line, doc, node))
            s, m = runs(node[order])
            firsts = order[s]
            b, blob = [], []
            if only is None:
                gone = order[_late(doc[order], line[order], s, m)]
                if len(gone):
                    b.append(-1 - int(gone[0]) % n_buckets)
                    blob.append(pack(doc[gone], line[gone]))
                spot = n_buckets + (mix(node[firsts].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
                o = np.argsort(spot, kind="stable")
                for a, k in zip(*runs(spot[o])):
                    i = firsts[o[a : a + k]]
                    b.append(int(spot[o[a]]))
                    blob.append(pack(node[i], doc[i], line[i]))
            is_first = np.zeros(len(node), bool)
            is_first[firsts] = True
            columns, offset = [], 0
            for p, n in zip(parts, base):
                x = p[5]
                mine = np.flatnonzero(is_first[offset : offset + n])
                length = x.size[mine] - -(-percent * x.size[mine] // 100) + 1
                pos = spread(length)
                of = np.repeat(mine, length)
                columns.append((x.tokens[x.first[of] + pos], of + offset, pos))
                offset += n
            token, of, pos = (np.concatenate(c) for c in zip(*columns))
            place = mix(token)
            if only is not None:
                keep = may_hold(only.value, token.view(np.int64))
                token, of, pos, place = token[keep], of[keep], pos[keep], place[keep]
            spot = (place % np.uint64(n_buckets)).astype(np.uint32 if n_buckets > 65535 else np.uint16)
            o = np.argsort(spot, kind="stable")
            for a, k in zip(*runs(spot[o])):
                j = o[a : a + k]
                i = of[j]
                b.append(int(spot[j[0]]))
                blob.append(pack(token[j], node[i], size[i].astype(np.uint32), pos[j].astype(np.uint32), *np.ascontiguousarray(bits[i].T), doc[i], line[i]))
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(blob, pa.binary())], ["b", "blob"])

    return blobs


def _passing(n, pos, bits, a, b, percent: int) -> np.ndarray:
    """Length, positional and parity filter of pairs of a run. A narrow parity map is the fold of a wider one."""
    na, nb = n[a], n[b]
    need = needed(na, nb, percent)
    small = np.minimum(na, nb)
    most = na + nb - 2 * need
    # sets of a run differ: by one element at least, by two if they are of one size
    ok = (100 * small >= percent * np.maximum(na, nb)) & (1 + np.minimum(na - pos[a] - 1, nb - pos[b] - 1) >= need) & (most >= 2 - (na + nb) % 2)
    i = np.flatnonzero(ok)
    x = bits[a[i]] ^ bits[b[i]]
    count = np.bitwise_count
    two = x[:, :2] ^ x[:, 2:]
    apart = np.select([small[i] > VERY_WIDE, small[i] > WIDE], [count(x).sum(1), count(two).sum(1)], count(two[:, 0] ^ two[:, 1]))
    ok[i] = apart <= most[i]
    return ok


def _candidates(start, length, n, pos, bits, percent: int, hubs: int, enough: int, long: int):
    """For runs whose members stand in order of time: (later, earlier) pairs that pass, and the members that have enough with their run's first ones, so the rest wasn't tried.

    All runs go side by side: members of long runs meet the run's first
    ``hubs``; then, in order of size, each member meets those within the
    length filter's reach, in blocks of pairs.
    """
    run = np.repeat(np.arange(len(start)), length)
    hits = np.zeros(len(n), np.int64)
    found_a, found_b = [], []
    i = np.flatnonzero(np.repeat(length > long, length))
    head = np.repeat(start, length)
    for h in range(hubs):
        i = i[(hits[i] < enough)]
        j = i[i > head[i] + h]
        for lo in range(0, len(j), BLOCK_PAIRS):
            a = j[lo : lo + BLOCK_PAIRS]
            b = head[a] + h
            ok = _passing(n, pos, bits, a, b, percent)
            found_a.append(a[ok])
            found_b.append(b[ok])
            hits[a[ok]] += 1
    settled = np.flatnonzero(hits >= enough)
    tried = np.where(np.repeat(length > long, length), head + hubs, 0)  # earlier members below this place were met
    by_size = np.lexsort((n, run))
    key = (run[by_size].astype(np.int64) << 32) | n[by_size]
    last = np.searchsorted(key, (run[by_size].astype(np.int64) << 32) | (n[by_size] * 100 // percent), "right")
    reach = last - np.arange(len(key)) - 1
    total = np.cumsum(reach)
    lo = 0
    while lo < len(key):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + BLOCK_PAIRS, "right")))
        r = reach[lo:hi]
        x = np.repeat(np.arange(lo, hi), r)
        y = x + 1 + spread(r)
        x, y = by_size[x], by_size[y]
        a, b = np.maximum(x, y), np.minimum(x, y)
        keep = (hits[a] < enough) & (b >= tried[a])
        a, b = a[keep], b[keep]
        ok = _passing(n, pos, bits, a, b, percent)
        found_a.append(a[ok])
        found_b.append(b[ok])
        lo = hi
    return np.concatenate(found_a), np.concatenate(found_b), settled


def _matches(percent: int, n_buckets: int, wanted=None):
    """Candidates by element (kind 0 pairs, kind 1 in reserve), repeats by set (kind 2). With ``wanted``, all pairs of the sets that it may hold."""

    def each(batches):
        for bucket, rows in buckets_of(batches):
            if bucket < 0:
                for r in rows:
                    yield _out(2, *unpack(r["blob"], np.int64, np.int64))
                continue
            if bucket >= n_buckets:
                node, doc, line = (np.concatenate(c) for c in zip(*[unpack(r["blob"], np.int64, np.int64, np.int64) for r in rows]))
                order = np.lexsort((line, doc, node))
                late = _late(doc[order], line[order], *runs(node[order]))
                yield _out(2, doc[order[late]], line[order[late]])
                continue
            token, node, n, pos, *bits, doc, line = (np.concatenate(c) for c in zip(*[unpack(r["blob"], *ENTRY) for r in rows]))
            bits = np.stack(bits, 1)
            order = np.argsort(token, kind="stable")
            s, m = runs(token[order])
            several = m > 1
            keep = order[np.repeat(s[several], m[several]) + spread(m[several])]
            if not len(keep):
                continue
            token, node, n, pos, bits, doc, line = (c[keep] for c in (token, node, n, pos, bits, doc, line))
            time = np.empty(len(doc), np.int64)
            time[np.lexsort((line, doc))] = np.arange(len(doc))
            order = np.lexsort((time, node, token))
            once = np.concatenate(([True], (token[order][1:] != token[order][:-1]) | (node[order][1:] != node[order][:-1])))
            keep = order[once]
            keep = keep[np.lexsort((time[keep], token[keep]))]
            token, n, pos, bits, doc, line = token[keep], n[keep].astype(np.int64), pos[keep].astype(np.int64), bits[keep], doc[keep], line[keep]
            s, m = runs(token)
            everything = wanted is not None
            a, b, settled = _candidates(s, m, n, pos, bits, percent, 0 if everything else HUBS, SETTLED, LONG)
            if wanted is not None:
                ok = may_hold(wanted.value, _place(doc[a], line[a]))
                yield _out(0, doc[a[ok]], line[a[ok]], doc[b[ok]], line[b[ok]])
                continue
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first, k = runs(a)
            at = spread(k)
            now = at < FIRST
            yield _out(0, doc[a[now]], line[a[now]], doc[b[now]], line[b[now]])
            later = (at >= FIRST) & (at < RESERVE)
            if later.any():
                x, y = a[later], b[later]
                f, c = runs(x)
                yield _out(1, doc[x[f]], line[x[f]], more=[pack(doc[y[i : i + j]], line[y[i : i + j]]) for i, j in zip(f, c)])
            over = np.concatenate([a[first[k > RESERVE]], settled])
            if len(over):
                yield _out(3, doc[over], line[over])

    return each


class LineJoin:
    def __init__(self, docs: DataFrame, percent: int):
        self.spark, self.percent = docs.sparkSession, percent
        prepare(self.spark)
        typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.key = keyed(typed)
        self.docs = typed.select(self.key[0].alias("doc_id"), "text", self.key[1].alias("sub"))

        def count(batches):
            total = np.zeros(1 << SLOT_BITS, np.int64)
            for batch in slices(batches):
                total += np.bincount((Words(batch.column(1), lower=True).hash >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
            return total

        counts = count_blocks(self.docs, count)
        self.classes = self.spark.sparkContext.broadcast(classes_of(counts) if len(counts) else np.zeros(1 << SLOT_BITS, np.uint64))
        self.n = max(LEAST_BUCKETS, math.ceil(6 * float(counts.sum()) / BUCKET_BYTES))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """(doc, line) of the later lines of the pairs that match."""
        percent, classes = self.percent, self.classes
        ends = written(pairs.select("doc", "line").union(pairs.select("other_doc", "other_line")).distinct(), "ends")
        n_ends = ends.count()
        by_doc = self.spark.sparkContext.broadcast(id_filter(ends, "doc", n_ends))
        texts, few = self.docs, ends.select(F.col("doc").alias("doc_id")).distinct().limit(BROADCAST_DOCS + 1)
        if ends.agg(F.approx_count_distinct("doc")).first()[0] < BROADCAST_DOCS // 2 and few.count() <= BROADCAST_DOCS:
            texts = texts.join(F.broadcast(few), texts["doc_id"] == few["doc_id"], "left_semi")

        def places(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_place(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], ["id"])

        by_place = self.spark.sparkContext.broadcast(id_filter(ends.mapInArrow(places, "id long"), n=n_ends))

        def fetch(batches):
            for batch in slices(batches):
                keep = np.flatnonzero(may_hold(by_doc.value, _ids(batch.column(0))))
                if not len(keep):
                    continue
                part = batch.take(pa.array(keep))
                x = Lines(part.column(1), classes.value, _ids(part.column(2)))
                doc = _ids(part.column(0))[x.doc]
                i = np.flatnonzero(may_hold(by_place.value, _place(doc, x.number)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(x.number[i]), pa.array([x.tokens[x.first[k] : x.first[k] + x.size[k]].tobytes() for k in i], pa.binary())], ["doc", "line", "elements"])

        sets = texts.mapInArrow(fetch, "doc long, line long, elements binary").join(ends, ["doc", "line"], "left_semi")
        sets = written(sets, "lines")
        left = sets.withColumnRenamed("elements", "x")
        right = sets.select(F.col("doc").alias("other_doc"), F.col("line").alias("other_line"), F.col("elements").alias("y"))

        def check(batches):
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(a) + len(b) - len(set(a.tolist()).union(b.tolist()))
                    ok.append(100 * common >= percent * (len(a) + len(b) - common))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["doc", "line"])

        met = pairs.hint("merge").join(left.hint("merge"), ["doc", "line"]).hint("merge").join(right.hint("merge"), ["other_doc", "other_line"]).select("doc", "line", "x", "y")
        found = written(met.mapInArrow(check, "doc long, line long").distinct(), "matched")
        drop(sets, ends, pairs)
        return found

    def removed(self) -> DataFrame:
        """(doc, line) of every line that an earlier one matches; places are as ``keyed`` makes them."""
        key = ["doc", "line"]
        blobs = self.docs.mapInArrow(_slice_rows(self.classes, self.percent, self.n), "b int, blob binary")
        found = written(dealt(blobs, self.n).mapInArrow(_matches(self.percent, self.n), OUT), "matches")
        release(self.spark)
        pair = [*key, "other_doc", "other_line"]
        gone = self._verified(written(found.filter("kind = 0").select(pair).distinct(), "pairs"))
        reserve = found.filter("kind = 1").select(*key, "more").join(gone, key, "left_anti")

        def expand(batches):
            for batch in batches:
                for d, l, blob in zip(*[c.to_pylist() for c in batch.columns]):
                    doc, line = unpack(blob, np.int64, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), d)), pa.array(np.full(len(doc), l, np.int64)), pa.array(doc), pa.array(line)], pair)

        more = written(reserve.mapInArrow(expand, "doc long, line long, other_doc long, other_line long").distinct(), "pairs")
        if not more.isEmpty():
            gone = gone.unionByName(self._verified(more))
        rest = written(found.filter("kind = 3").select(key).distinct().join(gone, key, "left_anti"), "rest")
        if left := rest.count():
            gone = gone.unionByName(self._directly(rest) if left <= DIRECT_LINES else self._verified(self._all_of(rest)))
        return found.filter("kind = 2").select(key).unionByName(gone)

    def _directly(self, rest: DataFrame) -> DataFrame:
        """The matched ones of a few lines: all texts pass once by their sets, which every task has."""
        percent, classes = self.percent, self.classes
        keys = {(r["doc"], r["line"]) for r in rest.collect()}
        few = F.broadcast(rest.select(F.col("doc").alias("few")).distinct())

        def fetch(batches):
            for batch in slices(batches):
                x, ids = Lines(batch.column(1), classes.value, _ids(batch.column(2))), _ids(batch.column(0))
                at = [k for k in range(len(x.node)) if (int(ids[x.doc[k]]), int(x.number[k])) in keys]
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[x.doc[k]]) for k in at], pa.int64()), pa.array([int(x.number[k]) for k in at], pa.int64()), pa.array([x.tokens[x.first[k] : x.first[k] + x.size[k]].tobytes() for k in at], pa.binary())], ["doc", "line", "elements"])

        own = self.docs.join(few, self.docs["doc_id"] == few["few"], "left_semi")
        sets = [(r["doc"], r["line"], np.frombuffer(r["elements"], np.uint64)) for r in own.mapInArrow(fetch, "doc long, line long, elements binary").collect()]
        holders: dict[int, list[int]] = {}
        for k, (_, _, x) in enumerate(sets):
            for token in x[: len(x) + 1 + -percent * len(x) // 100].tolist():
                holders.setdefault(token, []).append(k)
        shared = self.spark.sparkContext.broadcast((np.array(sorted(holders), np.uint64), holders, sets))

        def scan(batches):
            wanted, holders, sets = shared.value
            for batch in slices(batches):
                w = Words(batch.column(1), lower=True)
                # texts with one of the elements; only these are cut into lines
                some = np.unique(w.doc[_among(wanted, tokens_of(w.hash, classes.value))])
                if not len(some):
                    continue
                batch = batch.take(pa.array(some))
                x, ids = Lines(batch.column(1), classes.value, _ids(batch.column(2))), _ids(batch.column(0))
                hit = np.flatnonzero(_among(wanted, x.tokens))
                lines = np.searchsorted(x.first, hit, "right") - 1
                found = set()
                for l, k in {(l, k) for l, token in zip(lines.tolist(), x.tokens[hit].tolist()) for k in holders[token]}:
                    doc, line, y = sets[k]
                    if (int(ids[x.doc[l]]), int(x.number[l])) < (doc, line):
                        common = len(np.intersect1d(x.tokens[x.first[l] : x.first[l] + x.size[l]], y, assume_unique=True))
                        if 100 * common >= percent * (int(x.size[l]) + len(y) - common):
                            found.add((doc, line))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([l for _, l in found], pa.int64())], ["doc", "line"])

        return written(self.docs.mapInArrow(scan, "doc long, line long").distinct(), "matched")

    def _all_of(self, rest: DataFrame) -> DataFrame:
        """All candidates of the lines in ``rest``: the entries of their elements once more."""
        percent, classes = self.percent, self.classes

        def places(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_place(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], ["id"])

        wanted = self.spark.sparkContext.broadcast(id_filter(rest.mapInArrow(places, "id long"), n=rest.count()))

        def elements(batches):
            for batch in slices(batches):
                x = Lines(batch.column(1), classes.value, _ids(batch.column(2)))
                i = np.flatnonzero(may_hold(wanted.value, _place(_ids(batch.column(0))[x.doc], x.number)))
                length = x.size[i] - -(-percent * x.size[i] // 100) + 1
                yield pa.RecordBatch.from_arrays([pa.array(x.tokens[np.repeat(x.first[i], length) + spread(length)].view(np.int64))], ["id"])

        only = self.spark.sparkContext.broadcast(id_filter(self.docs.mapInArrow(elements, "id long")))
        blobs = self.docs.mapInArrow(_slice_rows(classes, percent, self.n, only), "b int, blob binary")
        found = dealt(blobs, self.n).mapInArrow(_matches(percent, self.n, wanted), OUT)
        pair = ["doc", "line", "other_doc", "other_line"]
        return written(found.select(pair).distinct().join(rest, ["doc", "line"], "left_semi"), "pairs")


def line_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """All rows and columns of ``docs``, the text without removed lines, plus n_lines and n_removed (lines with words)."""
    join = LineJoin(docs, percent)
    at, sub = F.col("line").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int"), F.shiftright("line", LINE_BITS)
    lists = join.removed().groupBy(F.col("doc").alias("_doc"), sub.alias("_sub")).agg(F.array_sort(F.collect_set(at)).alias("_gone"))
    typed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    typed = typed.withColumns(dict(zip(("_key", "_digest"), join.key)))
    rows = typed.join(lists, (F.col("_key") == F.col("_doc")) & (F.col("_digest") == F.col("_sub")), "left").withColumn("_lines", F.split("text", "\n"))
    kept = F.array_join(F.filter("_lines", lambda x, i: ~F.array_contains("_gone", i)), "\n")
    n_lines = F.coalesce(F.size(F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")
    new = {"n_lines": n_lines, "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    out = rows.withColumns({k: v for k, v in new.items() if k not in docs.columns} | {"text": F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept)})
    return out.select(*docs.columns, *[k for k in new if k not in docs.columns])
