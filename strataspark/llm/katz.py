"""LM scoring: one Katz backoff model of order three for the whole corpus, kept in partitioned tables.

P(w | u v) = d3(r) r / c(u v) for a triple seen r times in training, else
alpha(u v) P(w | v); the same with d2 one word shorter, down to Good-Turing
discounted word counts and what they leave for the unknown word.  Counts up to
``K`` are discounted by Good-Turing ratios from the counts of counts of the
whole corpus, one vector an order; alpha makes each distribution sum to exactly
1.  A text's first token has the order of two, as its history is the start.

Flow (packed columns; a chunk is about ``CHUNK_BYTES`` of texts):
1. chunks become sequences of chunk-local word numbers, kept in a table; the
   word partitions count the words, number them, and answer each chunk;
2. for each order, chunks meet their answers so far and send their distinct
   n-grams with training counts to partitions by history.  These sum the
   counts (the model's table) and answer each chunk: the n-gram's count, and of
   a history that must back off how many words follow it once, twice, ... and
   their lower-order mass.  Discounts are the sums of all partitions' counts of counts, so
   they, and all scores, are the same under any partitioning;
3. chunks meet all answers and evaluate the recursion token by token.
A chunk that holds all training occurrences of a history sends them, but needs
no answer.  A history that would fill a quarter of a partition is split by
word; its sums are added up and broadcast (four a partition at most, 64 bytes each).

Defined cases: a null text is an empty one, whose only token is the end; rows
that share a doc_id are scored each; with nothing to train on every token is
unknown and has probability 1; a null doc_id counts as training unless
``held_out`` says otherwise; a text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_of, dealt, drop, mix, prepare, release, runs, trim, unpack, written
from .common import pack as _pack
from .textops import Words, slices

pack = partial(_pack, level=3)
K = 5
END = np.uint64(1)
CHUNK_BYTES = 5 << 20
PARTITION_TOKENS = 3 << 19
LEAST_PARTITIONS = 64
HOT_TOKENS = 1000

ROW = "kind int, b int, chunk long, x binary, y binary, z binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
#: Kinds of rows; answers of order k are TOLD + k.
OWN, ASK, STATS, HOT, TOLD = 0, 1, 2, 3, 10


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], ["kind", "b", "chunk", "x", "y", "z"])


def _alone(groups, work):
    """``work`` on a group of rows at a time: nothing of the last one is held while the next is gathered."""
    for key, rows in groups:
        yield from work(key, rows)
        rows.clear()
        trim()


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """0..n-1, rising with the hash."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.uint16 if n <= 1 << 16 else np.int32)


def discounts(n: np.ndarray) -> np.ndarray:
    """d_0..d_K from counts of counts n_0..n_{K+1}: Good-Turing ratios where they lie between 0 and 1, else a mild constant."""
    d = np.ones(K + 1)
    if n[1] and n[K + 1]:
        tail = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] and tail < 1:
                d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
    d[1:][~((d[1:] > 0.01) & (d[1:] < 1))] = 0.9
    return d


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    return r * np.where(r <= K, d[np.minimum(r, K)], 1.0)


def counts_of_counts(r: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(r, K + 2), minlength=K + 3)[: K + 2]


class Unigrams:
    """P(w) by training count; what is left is the unknown word's."""

    def __init__(self, n: np.ndarray, total: int, types: int):
        self.total, self.types, self.d = total, types, discounts(n)
        kept = sum(self.d[r] * r * n[r] for r in range(1, K + 1))
        big = total - sum(r * n[r] for r in range(1, K + 1))
        left = total - kept - big
        self.scale = 1.0
        if total and left <= 0:  # all counts are large: one more token is set aside
            self.scale, left = total / (total + 1), 1.0
            self.unknown = left / (total + 1)
        else:
            self.unknown = left / total if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) * (self.scale / max(self.total, 1)), self.unknown)


class Model:
    """What tasks know of the whole corpus: the words' distribution, and by order (2, 3) discounts and split histories."""

    def __init__(self, words: Unigrams, documents: int, n_buckets: int, hot: int):
        self.words, self.documents, self.n, self.hot = words, documents, n_buckets, hot
        self.d: dict[int, np.ndarray] = {}
        self.split: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + np.uint64(0x9E3779B97F4A7C15)) + b)


# ---------------------------------------------------------------- words


def _chunk_rows(n_buckets: int):
    def chunks(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", CHUNK_BYTES):
            hashes, counts = [], []
            for piece in slices(iter([batch])):
                w = Words(piece.column(2), lower=True)
                hashes.append(w.hash)
                counts.append(w.counts)
            hashes, counts = np.concatenate(hashes), np.concatenate(counts)
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(counts)), counts)
            tokens = np.full(len(hashes) + len(counts), END, np.uint64)
            tokens[np.arange(len(hashes)) + doc] = hashes
            of = np.repeat(np.arange(len(counts)), counts + 1)
            vocab, local = np.unique(tokens, return_inverse=True)
            seen = np.bincount(local[train[of]], minlength=len(vocab))
            chunk = (part << 24) + seq
            seq += 1
            # numbers by frequency compress well: the frequent words have the small ones
            by_use = np.argsort(-np.bincount(local, minlength=len(vocab)), kind="stable")
            number = np.empty(len(vocab), np.uint32)
            number[by_use] = np.arange(len(vocab), dtype=np.uint32)
            meta = pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), (counts + 1).astype(np.uint32), train.astype(np.uint8) | (null.astype(np.uint8) << 1))
            # the vocabulary is sorted, and buckets rise with the hash: answers come back in its order
            rows = [(OWN, -1, chunk, pack(number), pack(number[local]), meta)]
            first, n = runs(_bucket(vocab, n_buckets))
            b = _bucket(vocab, n_buckets)
            rows += [(ASK, int(b[f]), chunk, pack(vocab[f : f + m]), pack(seen[f : f + m].astype(np.uint32)), None) for f, m in zip(first, n)]
            yield _batch(rows)

    return chunks


def _word_table(n_buckets: int):
    """Training counts and numbers of each chunk's words; numbers start at 1, the frequent words' are small."""

    def each(batches):
        for b, rows in buckets_of(batches):
            parts = [(unpack(r["x"], np.uint64)[0], unpack(r["y"], np.uint32)[0]) for r in rows]
            words, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            count = np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(words)).astype(np.int64)
            number = np.empty(len(words), np.uint64)
            number[np.argsort(-count, kind="stable")] = np.arange(len(words), dtype=np.uint64) * np.uint64(n_buckets) + np.uint64(b + 1)
            out, at = [(STATS, b, -1, np.concatenate((counts_of_counts(count), [count.sum(), (count > 0).sum()])).astype(float).tobytes(), None, None)], 0
            for r, p in zip(rows, parts):
                mine = where[at : at + len(p[0])]
                out.append((TOLD + 1, b, r["chunk"], pack(number[mine], count[mine].astype(np.uint64)), None, None))
                at += len(p[0])
            yield _batch(out)

    return each


# ---------------------------------------------------------------- chunks and their n-grams


class Grams:
    """Distinct n-grams of a chunk: ``at`` of each token; of each n-gram its history's index ``hist``, its last word and training count here.

    Of each history: its number pair (a, b), training count ``c`` in the corpus and ``own`` here, ``below`` of the shorter history, and ``common``, the count of b.
    """

    def __init__(self, hist, word, train, n_words, a, b, c, own, lower, below, common):
        keys, self.at = np.unique(hist * n_words + word, return_inverse=True)
        self.hist, self.word = keys // n_words, keys % n_words
        self.seen = np.bincount(self.at[train], minlength=len(keys))
        self.a, self.b, self.c, self.own, self.below, self.common = a, b, c, own, below, common
        self.lower = np.empty(len(keys), np.int64)  # the count that the lower order's probability rests on
        self.lower[self.at] = lower

    def asked(self, m: Model, word_ids: np.ndarray):
        """N-grams with a known history in the order of the messages, their buckets, and the messages' histories: starts, lengths."""
        grams = np.flatnonzero((self.c > 0)[self.hist])
        hist = self.hist[grams]
        # by the history's last word, whose neighbours then share bytes; frequent words by the whole history, frequent histories by the n-gram
        key = _key(np.where(self.common > m.hot, self.a, np.uint64(0)), self.b)
        spot = _bucket(key[hist], m.n)
        split = (self.c > m.hot)[hist]
        if split.any():
            spot[split] = _bucket(mix(key[hist[split]] ^ mix(word_ids[self.word[grams[split]]])), m.n)
        by = np.lexsort((self.a, self.b))
        rank = np.empty(len(by), np.uint32)
        rank[by] = np.arange(len(by), dtype=np.uint32)
        order = np.lexsort((rank[hist], spot))
        grams, spot = grams[order], spot[order]
        hist = self.hist[grams]
        new = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (hist[1:] != hist[:-1])))) if len(grams) else np.zeros(0, np.int64)
        return grams, spot, new, np.diff(np.append(new, len(grams)))

    def local_classes(self, lower_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By history: how many words follow it 1..K times, and their lower-order mass, as far as this chunk knows."""
        return classes_of(self.hist, self.seen, lower_p, len(self.c))


def classes_of(hist, r, lower_p, n_hist) -> tuple[np.ndarray, np.ndarray]:
    classes = np.bincount(hist * (K + 2) + np.minimum(r, K + 1), minlength=n_hist * (K + 2)).reshape(n_hist, K + 2)[:, 1 : K + 1]
    return classes, np.bincount(hist, weights=np.where(r > 0, lower_p, 0.0), minlength=n_hist)


def backs_off(r: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which histories have an n-gram that training never saw: only these need their classes and lower-order mass."""
    return np.bincount(np.repeat(np.arange(len(lengths)), lengths)[r == 0], minlength=len(lengths)) > 0


class Chunk:
    """A chunk's tokens with their words' numbers and counts; ``order2`` and ``order3`` as far as it has been told."""

    def __init__(self, chunk: int, rows: list[dict], m: Model):
        self.chunk, self.m, self.rows = chunk, m, rows
        own = next(r for r in rows if r["kind"] == OWN)
        self.ids, counts, self.flags = unpack(own["z"], np.int64, np.uint32, np.uint8)
        number, self.word = unpack(own["x"], np.uint32)[0], unpack(own["y"], np.uint32)[0].astype(np.int64)
        told = [unpack(r["x"], np.uint64, np.uint64) for r in self._told(1)]
        n = len(number)
        self.word_ids, self.count = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
        self.word_ids[number] = np.concatenate([t[0] for t in told])
        self.count[number] = np.concatenate([t[1] for t in told]).astype(np.int64)
        self.count[n] = m.documents  # the start of a text is a history too
        self.counts = counts.astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.train = np.repeat(self.flags & 1, self.counts).astype(bool)
        before = np.concatenate(([0], self.word[:-1]))
        before[self.starts] = n
        h = np.arange(n + 1)
        self.order2 = Grams(before, self.word, self.train, n + 1, np.zeros(n + 1, np.uint64), self.word_ids, self.count, np.bincount(before[self.train], minlength=len(h)), self.count[self.word], np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64))

    def _told(self, order: int) -> list[dict]:
        return sorted((r for r in self.rows if r["kind"] == TOLD + order), key=lambda r: r["b"])

    def ask(self, g: Grams) -> list[tuple]:
        m = self.m
        grams, spot, new, length = g.asked(m, self.word_ids)
        hist, rows = g.hist[grams[new]], []
        at_head = 0
        for f, n in zip(*runs(spot)):
            heads = slice(at_head, int(np.searchsorted(new, f + n)))
            at_head = heads.stop
            h, mine = hist[heads], grams[f : f + n]
            x = pack(g.a[h], g.b[h], g.below[h], length[heads].astype(np.uint32), (g.c[h] > m.hot).astype(np.uint8) | ((g.own[h] == g.c[h]).astype(np.uint8) << 1))
            rows.append((ASK, int(spot[f]), self.chunk, x, pack(self.word_ids[g.word[mine]], g.seen[mine].astype(np.uint32), g.lower[mine].astype(np.uint64)), None))
        return rows

    def answered(self, g: Grams, order: int, lower_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The corpus's count of each n-gram, its probability, and ``below`` of each history."""
        m, d = self.m, self.m.d[order]
        whole = g.own == g.c
        classes, back = g.local_classes(lower_p)
        rest, full = 1 - back, classes.sum(1) == 0
        r = np.where(whole[g.hist], g.seen, 0)
        grams, _, new, length = g.asked(m, self.word_ids)
        told = self._told(order)
        if told:
            hist = g.hist[grams[new]]
            grams, length, hist = grams[~whole[g.hist[grams]]], length[~whole[hist]], hist[~whole[hist]]
            r[grams] = np.concatenate([unpack(t["x"], np.uint64)[0] for t in told]).astype(np.int64)
            full[hist] = np.concatenate([unpack(t["z"], np.uint8)[0] for t in told]) > 0
            of = list(zip(*[unpack(t["y"], *[np.uint32] * K, np.float32) for t in told]))
            back_off = hist[backs_off(r[grams], length)]
            classes[back_off] = np.stack([np.concatenate(c) for c in of[:K]], 1)
            rest[back_off] = np.concatenate(of[K])
            keys, sums = m.split[order]
            if len(keys):
                hot = np.unique(hist[g.c[hist] > m.hot])
                at = np.searchsorted(keys, _key(g.a[hot], g.b[hot]))
                classes[hot], rest[hot] = sums[at, :K], 1 - sums[at, K]
                full[hot] = classes[hot].sum(1) == 0
        times = np.arange(1, K + 1)
        kept = classes @ (times * d[1:]) + (g.c - classes @ times)
        # a history without any discounted n-gram sets one more token aside
        below = np.where(g.c > 0, g.c + full, 1)
        alpha = np.where(g.c > 0, (below - kept) / below / np.maximum(rest, 1e-15), 1.0)
        return r, np.where(r > 0, discounted(r, d) / below[g.hist], alpha[g.hist] * lower_p), below

    def evaluate2(self):
        """Order two: counts of the pairs, their probabilities, and ``below`` by word."""
        return self.answered(self.order2, 2, self.m.words.p(self.count[self.order2.word]))

    def grams3(self, r2: np.ndarray, below: np.ndarray) -> tuple[Grams, np.ndarray]:
        """Order three, of the tokens that aren't the first of their text."""
        g = self.order2
        later = np.ones(len(self.word), bool)
        later[self.starts] = False
        at = np.flatnonzero(later)
        return Grams(g.at[at - 1], self.word[at], self.train[at], len(self.count), self.word_ids[g.hist], self.word_ids[g.word], r2, g.seen, r2[g.at[at]], below[g.word].astype(np.uint64), self.count[g.word]), at


def _asks(order: int, lm):
    def one(chunk, rows):
        c = Chunk(chunk, rows, lm.value)
        if order == 2:
            out = c.ask(c.order2)
        else:
            r2, _, below = c.evaluate2()
            g = c.grams3(r2, below)[0]
            rows.clear()
            del c.order2, r2, below
            trim()
            out = c.ask(g)
        for lo in range(0, len(out), 32):
            yield _batch(out[lo : lo + 32])

    return lambda batches: _alone(buckets_of(batches, "chunk"), one)


def _table(order: int, lm):
    """One partition of the n-gram table at a time: counts, and the answers to all chunks."""

    def one(b, rows):
        m = lm.value
        heads = [unpack(r["x"], np.uint64, np.uint64, np.uint64, np.uint32, np.uint8) for r in rows]
        a, b2, below, length, flags = (np.concatenate(x) for x in zip(*heads))
        for r in rows:
            del r["x"]
        order_h = np.lexsort((b2, a))
        new = np.concatenate(([True], (a[order_h][1:] != a[order_h][:-1]) | (b2[order_h][1:] != b2[order_h][:-1])))
        rank = np.empty(len(a), np.int64)
        rank[order_h] = np.cumsum(new) - 1
        first_h = order_h[new]
        grams = [unpack(r.pop("y"), np.uint64, np.uint32, np.uint64) for r in rows]
        word, seen, lower = (np.concatenate(x) for x in zip(*grams))
        sizes = [len(x[0]) for x in grams]
        del grams
        hist = np.repeat(rank, length)
        order_g = np.lexsort((word, hist))
        new = np.concatenate(([True], (hist[order_g][1:] != hist[order_g][:-1]) | (word[order_g][1:] != word[order_g][:-1])))
        gram = np.empty(len(word), np.int64)
        gram[order_g] = np.cumsum(new) - 1
        first = order_g[new]
        del order_g, word
        r = np.bincount(gram, weights=seen).astype(np.int64)
        low = lower[first].astype(np.int64)
        p = m.words.p(low) if order == 2 else discounted(low, m.d[2]) / below[first_h][hist[first]]
        classes, back = classes_of(hist[first], r, p, len(first_h))
        del hist, first, low, p, seen, lower
        out = [(STATS, b, -1, counts_of_counts(r).astype(float).tobytes(), None, None)]
        at = at_h = 0
        for row, head, n in zip(rows, heads, sizes):
            open_h = head[4] < 2
            mine, wanted = rank[at_h : at_h + len(open_h)][open_h], gram[at : at + n][np.repeat(open_h, head[3])]
            full = (classes[mine].sum(1) == 0).astype(np.uint8)
            mine = mine[backs_off(r[wanted], head[3][open_h])]
            out.append((TOLD + order, b, row["chunk"], pack(r[wanted].astype(np.uint64)), pack(*classes[mine].astype(np.uint32).T.copy(), (1 - back[mine]).astype(np.float32)), pack(full)))
            at, at_h = at + n, at_h + len(open_h)
            if len(out) >= 64:
                yield _batch(out)
                out = []
        for i in np.flatnonzero(flags[first_h] & 1):
            out.append((HOT, b, -1, np.array([a[first_h[i]], b2[first_h[i]]], np.uint64).tobytes(), np.append(classes[i], back[i]).astype(float).tobytes(), None))
        if out:
            yield _batch(out)

    return lambda batches: _alone(buckets_of(batches), one)


def _documents(lm):
    def one(chunk, rows):
        c = Chunk(chunk, rows, lm.value)
        u = c.m.words
        r2, p2, below = c.evaluate2()
        p = p2[c.order2.at]
        g, at = c.grams3(r2, below)
        # order three is the largest step: what only order two needs goes first
        rows[:] = [r for r in rows if r["kind"] == TOLD + 3]
        del c.order2, r2, p2, below
        trim()
        if len(at):
            lower = np.empty(len(g.hist))
            lower[g.at] = p[at]
            p[at] = c.answered(g, 3, lower)[1][g.at]
        count = c.count[c.word]
        base, score = np.log10((count + 1) / (u.total + u.types + 1)), np.log10(p)
        known = np.add.reduceat((count > 0).astype(np.int64), c.starts)
        yield pa.RecordBatch.from_arrays([pa.array(c.ids, mask=(c.flags & 2) > 0), pa.array((c.flags & 1) == 0), pa.array(c.counts), pa.array(known), pa.array(np.add.reduceat(base, c.starts)), pa.array(np.add.reduceat(score, c.starts))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return lambda batches: _alone(buckets_of(batches, "chunk"), one)


# ---------------------------------------------------------------- driver


def _summed(table: DataFrame, kind: int, n: int, keyed: bool = False) -> list:
    """Sums of the rows of a kind (by history, if ``keyed``), added up by Spark before they come here."""
    names = [f"s{i}" for i in range(n)]

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                values = np.stack([np.frombuffer(v) for v in (y if keyed else x)])
                keys = np.stack([np.frombuffer(v, np.int64) for v in x]) if keyed else np.zeros((len(x), 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), *[pa.array(values[:, i].copy()) for i in range(n)]], ["a", "b2", *names])

    rows = table.filter(F.col("kind") == kind).select("x", "y").mapInArrow(each, "a long, b2 long, " + ", ".join(f"{k} double" for k in names))
    return rows.groupBy(*["a", "b2"] * keyed).agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in names]).collect()


def katz_scores(docs: DataFrame, held_out: Column, least_partitions: int = LEAST_PARTITIONS, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """Score every text; learn from the rows where ``held_out`` is not true. Gives doc_id, held_out, train_tokens, n_tokens, n_known, base_score and score (log10)."""
    spark = docs.sparkSession
    prepare(spark)
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held).alias("train"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 6).alias("bytes"), F.count_if("train").alias("train")).first()
    n = max(least_partitions, math.ceil((size["bytes"] or 0) / 6 / PARTITION_TOKENS))

    chunks = written(rows.mapInArrow(_chunk_rows(n), ROW), "chunks", by="kind")
    own = chunks.filter(F.col("kind") == OWN)
    told = [written(dealt(chunks.filter(F.col("kind") == ASK), n).mapInArrow(_word_table(n), ROW), "words")]
    drop(chunks, part=f"kind={ASK}")
    total = np.array(_summed(told[0], STATS, K + 4)[0])
    n_train = int(total[K + 2])
    model = Model(Unigrams(total[: K + 2], n_train, int(total[K + 3])), int(size["train"] or 0), n, max(hot_tokens, n_train // (4 * n)))

    def met() -> DataFrame:
        release(spark)
        rows = own
        for k, t in enumerate(told):
            rows = rows.unionByName(t.filter(F.col("kind") == TOLD + k + 1))
        return dealt(rows, n, "chunk")

    for order in (2, 3):
        lm = spark.sparkContext.broadcast(model)
        told.append(written(dealt(met().mapInArrow(_asks(order, lm), ROW), n).mapInArrow(_table(order, lm), ROW), f"order{order}"))
        model.d[order] = discounts(np.array(_summed(told[-1], STATS, K + 2)[0]))
        sums = _summed(told[-1], HOT, K + 1, keyed=True)
        keys = _key(np.array([r["a"] for r in sums], np.int64).view(np.uint64), np.array([r["b2"] for r in sums], np.int64).view(np.uint64))
        by = np.argsort(keys)
        model.split[order] = keys[by], np.array([r[2:] for r in sums], float).reshape(len(sums), K + 1)[by]
    done = met().mapInArrow(_documents(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(n_train).cast("long"))
