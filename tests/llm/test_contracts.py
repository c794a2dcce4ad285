"""The registered queries, whole, against their contracts on the smallest tables."""

import hashlib
import math
import re
import shutil
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataspark.llm import queries as Q

from .conftest import words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, name, folder=DATA):
    df = Q.queries()[name](spark, str(folder))
    rows = {r["doc_id"]: r for r in df.collect()}
    return df.columns, rows


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """The same texts; labels of held-out rows turned round, all sources other ones."""
    folder = tmp_path_factory.mktemp("changed")
    shutil.copytree(DATA, folder, dirs_exist_ok=True)
    held = Q._fold(5) == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.concat(F.lit("x"), F.col("doc_id")))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")).cast(labels.schema["quality"].dataType))
    for name, df in (("documents", docs), ("labels", labels)):
        (folder / f"{name}.parquet").unlink()
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_op4(spark, table):
    columns, got = run(spark, "op4_document_fingerprints")
    assert columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ids = sorted(table, reverse=True)
    text = {i: table[i]["text"] or "" for i in ids}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        k = len(text[i]) // 3
        edited = text[i][: len(text[i]) - k] + text[j][:k]
        assert got[i]["n_chars"] == len(text[i]) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert edited != text[i] or got[i]["fingerprint"] == got[i]["edited_fingerprint"]
        assert text[j] != text[i] or got[i]["near_next"] == 1
    assert set(got) == set(table)


def test_op5(spark, table):
    columns, got = run(spark, "op5_mixing_sources")
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(columns) and set(got) == set(table)
    size, taken = Counter(), Counter()
    for i, r in table.items():
        assert got[i]["size"] == len(words(r["text"])) and got[i]["taken"] <= 3 * got[i]["size"]
        size[r["source"]] += got[i]["size"]
        taken[r["source"]] += got[i]["taken"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target = {s: i % 3 + 1 for i, s in enumerate(names)}, {}
    while len(target) < len(names):  # full sources leave, the rest is shared again
        left, free = sum(size.values()) - sum(target.values()), [s for s in names if s not in target]
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if part[s] > 3 * size[s]]
        target |= {s: 3 * size[s] for s in full} if full else part
    for i, r in table.items():
        assert got[i]["source_size"] == size[r["source"]] and got[i]["target"] == pytest.approx(target[r["source"]], rel=1e-6)
    largest = {s: max(got[i]["size"] for i, r in table.items() if r["source"] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= max(largest[s], 0.01 * target[s]) for s in names)
    assert run(spark, "op5_mixing_sources")[1] == got


def test_op8(spark, table, changed):
    columns, got = run(spark, "op8_language_id")
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and set(got) == set(table)
    known = {r["lang"] for i, r in table.items() if fold(i, 5) and r["lang"] is not None}
    for i, r in table.items():
        assert got[i]["held_out"] == (fold(i, 5) == 0) and 0 <= got[i]["score"] <= 1
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert got[i]["lang_pred"] in known if lettered else got[i]["lang_pred"] == "und"
    held = [i for i, r in table.items() if got[i]["held_out"] and r["lang"] is not None and got[i]["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == table[i]["lang"] for i in held) >= 0.95 * len(held)
    assert run(spark, "op8_language_id", changed)[1] == got


def test_op9(spark, table):
    columns, got = run(spark, "op9_lm_scoring")
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} <= set(columns) and set(got) == set(table)
    tokens = {i: [*words(r["text"], True), None] for i, r in table.items()}
    count = Counter(t for i, x in tokens.items() if fold(i, 7) != 2 for t in x)
    n, v = sum(count.values()), len(count)
    for i, x in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 7) == 2, len(x), sum(count[t] > 0 for t in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in x), rel=1e-6)
        assert r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op10(spark, table, changed):
    columns, got = run(spark, "op10_quality_classifier")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and set(got) == set(table)
    for i in table:
        assert got[i]["held_out"] == (fold(i, 5) == 0) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.3)
    again = run(spark, "op10_quality_classifier", changed)[1]
    # the class weights, too, come from the training rows alone
    assert {i: r["score"] for i, r in again.items()} == pytest.approx({i: r["score"] for i, r in got.items()}, abs=1e-6)


def test_op6_cuts_only_lines_that_match_an_earlier_one(spark, table):
    _, got = run(spark, "op6_line_dedup")
    assert set(got) == set(table)
    for i, r in table.items():
        kept, rest = (got[i]["text"] or "").split("\n"), iter((r["text"] or "").split("\n"))
        assert got[i]["n_removed"] == 0 or all(any(line == x for x in rest) for line in kept if line)


def test_op2_finds_verbatim_items(spark, table):
    found = {(r["doc_id"], r["item_id"]) for r in Q.op2_benchmark_decontamination(spark, DATA).collect()}
    items = {r["item_id"]: words(r["text"], True) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    bare = lambda x: re.sub(r"[^a-z0-9 ]", "", " ".join(x))
    for i, r in table.items():
        text = f" {bare(words(r['text'], True))} "
        for item, x in items.items():
            if len(x) >= 8 and f" {bare(x)} " in text:
                assert (i, item) in found
