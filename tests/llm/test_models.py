import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataspark.llm import fingerprints as P
from strataspark.llm import quality as Q
from strataspark.llm.katz import K, Unigrams, discounts, katz_scores
from strataspark.llm.language_id import identify, viterbi
from strataspark.llm.mixing import mix_sources
from strataspark.llm.quality import quality
from strataspark.llm.textops import raw

from .conftest import words


def test_katz(docs, rows):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    got = {r["doc_id"]: r for r in katz_scores(docs, held).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = {i: [*words(t, True), "<end>"] for i, t, *_ in rows}
    count = {}
    for i, w in tokens.items():
        for x in w:
            count[x] = count.get(x, 0) + (not out[i])
    count = {k: v for k, v in count.items() if v}
    n = sum(count.values())
    for i, w in tokens.items():
        r = got[i]
        base = sum(math.log10((count.get(x, 0) + 1) / (n + len(count) + 1)) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(w), sum(x in count for x in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    again = {r["doc_id"]: r["score"] for r in katz_scores(docs.repartition(5), held).collect()}
    assert again == pytest.approx({i: r["score"] for i, r in got.items()}, rel=1e-7)


class BruteKatz:
    """The model by its definition."""

    def __init__(self, texts):
        from collections import Counter

        self.c, self.grams, self.h = Counter(), Counter(), Counter()
        for w in texts:
            w = ["<begin>", *w, "<end>"]
            for i in range(1, len(w)):
                self.c[w[i]] += 1
                for h in {(w[i - 1],), tuple(w[max(0, i - 2) : i])}:
                    self.h[h] += 1
                    self.grams[h, w[i]] += 1
        n = lambda c: np.bincount(np.minimum(list(c), K + 2), minlength=K + 3)[: K + 2]
        self.u = Unigrams(n(self.c.values()), sum(self.c.values()), len(self.c))
        self.d = {k: discounts(n([r for (h, _), r in self.grams.items() if len(h) == k])) for k in (1, 2)}

    def p(self, w, h):
        if not h:
            return float(self.u.p(np.array([self.c[w]]))[0])
        if not self.h[h]:
            return self.p(w, h[1:])
        seen = {b: r for (a, b), r in self.grams.items() if a == h}
        star = {b: r * (self.d[len(h)][r] if r <= K else 1.0) for b, r in seen.items()}
        below = self.h[h] + (sum(star.values()) >= self.h[h] - 1e-9)
        if w in star:
            return star[w] / below
        return (below - sum(star.values())) / below / (1 - sum(self.p(b, h[1:]) for b in seen)) * self.p(w, h[1:])

    def score(self, w):
        w = ["<begin>", *w, "<end>"]
        return sum(math.log10(self.p(w[i], tuple(w[max(0, i - 2) : i]))) for i in range(1, len(w)))


@pytest.mark.parametrize("partitions, hot, chunk", [(64, 1000, 8 << 20), (1, 1000, 8 << 20), (7, 5, 300), (64, 1, 120)])  # small: split histories, many chunks
def test_katz_equals_its_definition(spark, monkeypatch, partitions, hot, chunk):
    rng = random.Random(1)
    vocabulary = [f"v{k}" for k in range(30)]
    text = lambda n: [vocabulary[min(29, int(rng.paretovariate(0.8)) - 1)] for _ in range(n)]
    train = [text(rng.randrange(1, 30)) for _ in range(60)] + [["rare", "words", "stand", "here", "once"]] * 2
    probe = [[*text(10), "neverseen", *text(5)] for _ in range(20)] + [[], ["rare", "words", "stand", "v0"]]
    model = BruteKatz(train)
    for h in (("<begin>",), ("v0",), ("v7",), ("v29",), ("neverseen",), ("v0", "v0"), ("<begin>", "v1"), ("rare", "words"), ("v3", "neverseen")):
        assert sum(model.p(w, h) for w in [*model.c, "neverseen"]) == pytest.approx(1)
    monkeypatch.setattr("strataspark.llm.katz.CHUNK_BYTES", chunk)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(train)] + [(1000 + k, " ".join(w)) for k, w in enumerate(probe)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in katz_scores(df, F.col("doc_id") >= 1000, partitions, hot).collect()}
    for i, w in [*enumerate(train), *((1000 + k, w) for k, w in enumerate(probe))]:
        assert got[i] == pytest.approx(model.score(w), abs=1e-6 * (len(w) + 1)), i


def test_discounts_and_unigrams_are_exact():
    rng = np.random.default_rng(3)
    counts = np.minimum(rng.zipf(1.7, 5000), 400)
    n = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2]
    d = discounts(n)
    assert ((d[1:] > 0) & (d[1:] <= 1)).all()
    u = Unigrams(n, int(counts.sum()), len(counts))
    assert u.p(counts).sum() + u.unknown == pytest.approx(1)
    even = Unigrams(np.zeros(K + 2, np.int64), 700, 7)
    assert even.p(np.full(7, 100)).sum() + even.unknown == pytest.approx(1) and even.unknown > 0


def test_katz_edges(empty, odd):
    assert katz_scores(empty, F.lit(False)).collect() == []
    assert len(katz_scores(odd, F.lit(True)).collect()) == 4


def language(rng, kind, n):
    parts = {"a": ["the", "ing", "tion", "er", "wh"], "b": ["que", "ción", "ll", "ñ", "os"]}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_id(spark, empty):
    rng = random.Random(2)
    train = [(k, language(rng, k2, 40), k2) for k in range(60) for k2 in "ab"]
    df = spark.createDataFrame(train + [(9000, None, "a"), (9001, "x", None)], "doc_id long, text string, lang string")
    mixed = language(rng, "a", 30) + " " + language(rng, "b", 40)
    probe = spark.createDataFrame([(1, language(rng, "a", 20)), (2, language(rng, "b", 20)), (3, None), (4, "123 $$ --"), (5, ""), (6, mixed), (7, "Ж")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in identify(probe, df, spans=True).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6)] == ["a", "b", "und", "und", "und", "b"]
    assert got[7]["lang_pred"] in "ab" and all(0 <= r["score"] <= 1 for r in got.values())
    spans = [(s["lang"], s["start"], s["stop"]) for s in got[6]["spans"]]
    assert [s[0] for s in spans] == ["a", "b"] and abs(spans[0][2] - 30) <= 1
    assert identify(empty, df).collect() == []
    assert {r["lang_pred"] for r in identify(probe, df.limit(0)).collect()} == {"und"}


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    first = np.array([0, 5, 5, 12])
    scores, prior = rng.normal(0, 3, (12, 3)).astype(np.float32), np.log([0.5, 0.3, 0.2]).astype(np.float32)
    got = viterbi(scores, first, prior, 2.0)
    import itertools

    for a, b in zip(first, first[1:]):
        value = lambda p: prior[p[0]] + sum(scores[a + i, p[i]] for i in range(b - a)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731,B023
        if b > a:
            best = max(itertools.product(range(3), repeat=b - a), key=value)
            assert value(tuple(got[a:b])) == pytest.approx(value(best), abs=1e-4)


def test_quality(spark, empty):
    rng = random.Random(4)
    good = [(k, language(rng, "a", 60), 1) for k in range(150)]
    junk = [(1000 + k, " ".join(x + "$$$" for x in language(rng, "a", 60).split()), 0) for k in range(60)]
    df = spark.createDataFrame(good + junk + [(5000, None, None), (5001, "", None)], "doc_id long, text string, label int")
    train = df.filter("doc_id % 3 != 0")
    got = {r["doc_id"]: r for r in quality(df, train, train.select("doc_id", "label")).collect()}
    test = [(i, y) for i, _, y in good + junk if i % 3 == 0]
    assert sum(got[i]["predicted"] == y for i, y in test) / len(test) > 0.95
    assert got[5000]["score"] == got[5001]["score"] and 0 <= got[5000]["score"] <= 1
    assert quality(df, train, train.select("doc_id", "label").limit(0)).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)
    assert quality(empty, train, train.select("doc_id", "label")).collect() == []


def test_a_quality_score_depends_on_the_text_alone(spark, odd):
    rng = random.Random(6)
    texts = ["", "z" * 512, "z" * 511, "z" * 507, "y" * 1024] + ["".join(chr(rng.randrange(33, 900)) for _ in range(rng.randrange(1, 1500))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as label")
    model = Q.train(docs, labels)
    together = {r["doc_id"]: r["score"] for r in Q.score(docs.coalesce(1), model).collect()}
    back = {r["doc_id"]: r["score"] for r in Q.score(docs.orderBy(F.desc("doc_id")).coalesce(1), model).collect()}
    alone = {r["doc_id"]: r["score"] for r in Q.score(docs.repartition(len(texts)), model).collect()}
    assert together == pytest.approx(back, abs=1e-6) and together == pytest.approx(alone, abs=1e-6)
    got = quality(odd, docs, labels).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["doc_id"] != 2}) == 1


def test_chunks_cover_whole_texts():
    texts = ["", "a" * 512, "bc" * 300, "d"]
    rows, per, of = Q._chunks(*raw(pa.array(texts, pa.large_string())))
    assert per.tolist() == [1, 1, 2, 1] and of.tolist() == [0, 1, 2, 2, 3]
    for i, t in enumerate(texts):
        mine = rows[of == i]
        assert bytes(mine[:, : Q.CHUNK].ravel()).rstrip(b"\0") == t.encode()
        assert not mine[-1, Q.CHUNK :].any()
        assert all((x[Q.CHUNK :] == y[: Q.WIDTH]).all() for x, y in zip(mine, mine[1:]))


def test_fingerprints(docs, rows, empty, odd):
    got = {r["doc_id"]: r for r in P.edited_fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    import hashlib

    for (i, t, *_), (_, u, *_) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        k = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
    by = {}
    for i, t, *_ in rows:
        by.setdefault(t or "", set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    long = [r for i, r in got.items() if r["n_chars"] > 1000]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2
    assert P.edited_fingerprints(empty).collect() == [] and len(P.edited_fingerprints(odd).collect()) == 4
    one = P.decode(next(iter(got.values()))["fingerprint"])
    assert P.likeness(one, one) == 1.0


@pytest.mark.parametrize("window", [P.WINDOW, P.NARROW])
def test_entropy_bins(window):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 9, 700).astype(np.uint8)
    offsets = np.array([0, 100, 130, 130, 700])
    at, bins = P.entropy_bins(data, offsets, window)
    expected = {}
    for a, b in zip(offsets, offsets[1:]):
        for i in range(a, b - window + 1):
            c = np.bincount(data[i : i + window])
            p = c[c > 0] / window
            expected[i] = -(p * np.log2(p)).sum() / np.log2(window) * 1000
    assert list(at) == sorted(expected) and np.abs(bins - [expected[i] for i in at]).max() <= 0.51


def test_features_by_brute_force():
    """Each window picks the rarest (then first) of the neighbours that start within its width; often picked ones are features."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 97 + k, n).astype(np.uint8).tobytes() for k, n in [(4, 0), (5, 9), (6, 16), (7, 40), (20, 64), (9, 300), (15, P.SHORT - 1), (15, P.SHORT), (3, 3000)]]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    rank = np.stack([rng.permutation(P.BINS), rng.permutation(P.BINS)])
    expected = []
    for t in texts:
        spans = [t] if 0 < len(t) < P.NARROW else []
        for r, w in zip(rank, [P.WINDOW, P.NARROW] if len(t) < P.SHORT else [P.WINDOW]):
            at, bins = P.entropy_bins(np.frombuffer(t, np.uint8), np.array([0, len(t)]), w)
            picks = {}
            for i in at:
                best = min((r[bins[j]], j) for j in range(i, min(i + w, len(at))))[1]
                picks[best] = picks.get(best, 0) + 1
            often = [j for j, n in picks.items() if n >= w // 4] or list(picks)
            spans += [t[j : j + w] for j in often]
        expected.append(spans)
    doc, h = P.features(data, offsets, rank)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(x) for x in expected]
    by_text, by_hash = {}, {}
    for i, spans in enumerate(expected):
        for x in spans:
            by_text.setdefault(x, []).append(i)
    for i, x in zip(doc.tolist(), h.tolist()):
        by_hash.setdefault(x, []).append(i)
    assert sorted(map(sorted, by_text.values())) == sorted(map(sorted, by_hash.values()))


def test_short_texts_resemble_their_edits(spark):
    rng = random.Random(8)
    texts = [(i, language(rng, "ab"[i % 2], 12 + i % 30)) for i in range(120)]
    got = P.edited_fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert np.mean([r["near_edited"] for r in got]) > 0.3 > np.mean([r["near_next"] for r in got]) + 0.1
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.9


def test_mixing(docs, rows, empty, odd):
    got = mix_sources(docs).collect()
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, left, free = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
            free.discard(s)
    target |= {s: weight[s] * level for s in free}
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        longest = max(len(words(t)) for _, t, _, x, _ in rows if x == s)
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], longest / 2)
    # the dual's solution, by bisection
    for s in names:
        x = np.array([len(words(t)) for _, t, _, y, _ in rows if y == s]) / (size[s] / sum(y == s for _, _, _, y, _ in rows))
        lo, hi = -500.0, 500.0
        for _ in range(200):
            l = (lo + hi) / 2
            lo, hi = (l, hi) if (x * np.minimum(3, np.exp(np.minimum(l * x, 700)))).sum() * size[s] < target[s] * x.sum() else (lo, l)
        assert sorted(r["rate"] for r in got if r["source"] == s) == pytest.approx(sorted(np.minimum(3, np.exp(np.minimum(lo * x, 700)))), abs=1e-5)
    assert any(len({round(r["rate"], 6) for r in got if r["source"] == s}) > 5 for s in names)
    again = {r["doc_id"]: r["taken"] for r in mix_sources(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert mix_sources(empty).collect() == [] and len(mix_sources(odd).collect()) == 4


def test_katz_holds_one_group_at_a_time():
    """What a group needed is freed before the next one is gathered."""
    import weakref

    from strataspark.llm import katz

    seen = []

    def groups():
        for k in range(3):
            rows = [{"x": k}]
            yield k, rows
            assert seen[-1]() is None and rows == []

    def work(key, rows):
        held = np.zeros(10)
        seen.append(weakref.ref(held))
        yield key, len(rows)

    assert list(katz._alone(groups(), work)) == [(0, 1), (1, 1), (2, 1)]
