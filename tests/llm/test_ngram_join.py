import pytest

from strataspark.llm import ngram_join as J
from strataspark.llm.components import components

from .conftest import words


def brute(rows, k, percent):
    sets, comp = {}, {}
    for i, t, *_ in rows:
        w = words(t, True)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        comp[i] = i

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    comp[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, percent, split", [(4, 85, None), (5, 80, None), (4, 85, 8)])
def test_equals_brute_force(docs, rows, monkeypatch, k, percent, split):
    if split:  # runs are split by node and meet again
        monkeypatch.setattr(J, "SPLIT", split)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.ngram_join(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_near_copies_without_their_base(spark):
    """A large group whose members link only through some of the others: no link between components is lost."""
    base = [f"t{i}" for i in range(60)]
    texts = []
    for k in range(40):
        w = list(base)
        w[(k * 7) % 60] = f"e{k}"
        if k % 3:
            w[(k * 11 + 5) % 60] = f"f{k}"
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.ngram_join(df, 2, 85).collect()}
    assert got == brute(texts, 2, 85)


def test_edges(spark, empty, odd):
    assert J.ngram_join(empty).collect() == []
    got = [(r["doc_id"], r["component_id"]) for r in J.ngram_join(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (2, 2), (None, None)], key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150)]
    for small in (1_000_000, 0):
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long"), small=small).collect()}
        assert {got[i] for i in range(51)} == {0} and got[200] == got[150] == got[100] == 100
