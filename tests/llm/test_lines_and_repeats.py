import hashlib

import pytest

from strataspark.llm import line_dedup as L
from strataspark.llm.substring_dedup import substring_dedup

from .conftest import words


def brute_lines(rows, percent=80):
    seen, out = [], {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        kept = []
        for line in (t or "").split("\n"):
            s = set(words(line, True))
            hit = s and any(100 * len(s & o) >= percent * len(s | o) for o in seen)
            if s:
                seen.append(s)
            if not hit:
                kept.append(line)
        out[i] = None if t is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("direct", [None, 1000, 0])
def test_lines(docs, rows, monkeypatch, direct):
    if direct is not None:  # long runs, reserves and either last exact pass
        for k, v in {"DIRECT_LINES": direct, "FIRST": 1, "RESERVE": 2, "HUBS": 2, "SETTLED": 1, "LONG": 6}.items():
            monkeypatch.setattr(L, k, v)
    out = L.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(rows)


def test_line_edges(empty, odd):
    assert L.line_dedup(empty).collect() == []
    out = L.line_dedup(odd)
    got = sorted(((r["doc_id"], r["text"], r["n"]) for r in out.collect()), key=str)
    same = next(t for _, t, _ in got if t)
    assert out.columns[:7] == odd.columns and got == sorted([(1, "", 5), (1, "", 5), (None, same, 6), (2, None, 7)], key=str)


def test_rows_that_share_an_id(spark):
    """A repeated first row keeps its text, and a line that repeats in one null-id row stays in the others."""
    a, b, c = "first words of a row that stands twice\nand its second line", "alpha beta gamma\nalpha beta gamma\nrest one two", "delta epsilon zeta\neta theta iota\nkappa lambda mu"
    df = spark.createDataFrame([(1, a), (1, a), (2, a), (None, b), (None, c), (3, "own one\nown two"), (3, "own three\nown three")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in L.line_dedup(df.repartition(3)).collect()), key=str)
    assert got == sorted([(1, a, 0), (1, a, 0), (2, "", 2), (None, "alpha beta gamma\nrest one two", 1), (None, c, 0), (3, "own one\nown two", 0), (3, "own three", 1)], key=str)


def brute_repeats(rows, width):
    first, out = {}, {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("width, limit", [(13, 1 << 21), (13, 40), (4, 20)])  # small limits: longer prefixes, and nodes settled before the shuffle
def test_repeats(docs, rows, width, limit):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(docs, width, limit).collect()}
    assert got == brute_repeats(rows, width)


def test_repeat_edges(empty, odd):
    assert substring_dedup(empty).collect() == []
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_text"]) for r in substring_dedup(odd, 5, texts=True).collect()), key=str)
    assert [(i, n) for i, n, _ in got] == sorted([(1, 17), (1, 17), (2, 0), (None, 0)], key=str)
