import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_lines_and_repeats import brute_lines  # noqa: E402
from .test_ngram_join import brute  # noqa: E402


def test_stages(spark, rows, docs, tmp_path):
    """Each stage against brute force on its own input."""
    extra = [(99_001, "one two three four five six seven eight nine ten " + "bench mark item text with many plain words in one row", "a", "s1", 9)]
    d = str(tmp_path)
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "bench mark item text with many plain words in one row")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        stage(spark, now, d).write.parquet(f"{d}/{k}")
        now = spark.read.parquet(f"{d}/{k}")
        after = {r["doc_id"]: r for r in now.collect()}
        if k < 4:
            assert now.columns == docs.columns
        plain = [(r["doc_id"], r["text"]) for r in before]
        if name == "language_id":
            assert set(after) == {i for i, t in plain if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            left = brute_lines(plain)
            assert {i: r["text"] for i, r in after.items()} == {i: t for i, t in left.items() if t.strip(" \t\n\x0b\x0c\r") or t == dict(plain)[i]}
        elif name == "ngram_jaccard_join":
            assert set(after) == {i for i, _, c in brute(plain, 5, 80) if i == c}
        elif name == "benchmark_decontamination":
            assert set(after) == {i for i, _ in plain} - {99_001}
        else:
            assert all(1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in after.values())
    whole = corpus_pipeline.run(spark, d)
    assert {(r["doc_id"], r["copies"]) for r in whole.collect()} == {(i, r["copies"]) for i, r in after.items()}


def test_language_stage(spark):
    """Null labels are filled; without any label only texts without a letter go."""
    rows = [(1, "the thing other whether", "a"), (2, "que los niños llaman", "b"), (3, "other thing the whether", None), (4, "12 $$", None), (5, None, None)]
    df = spark.createDataFrame([(i, t, l, "s", 0) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = lambda d: {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, d, "").collect()}
    assert stage(df) == {1: "a", 2: "b", 3: "a"}
    assert stage(df.withColumn("lang", F.lit(None).cast("string"))) == {1: None, 2: None, 3: None}


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).agg(F.count("*")).first()[0] > 0


def test_odd_rows(spark, empty, odd, tmp_path):
    """Empty tables, repeated rows, null ids and texts, clashing names pass every stage."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
        out = stage(spark, odd, str(tmp_path))
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert not {"n", "score"} & set(out.columns)
        text = odd.filter("text is not null").first()["text"]
        first = {"language_id": [(1, text), (1, text), (None, text)], "ngram_jaccard_join": [(1, text), (2, None), (None, text)], "benchmark_decontamination": [(1, text), (1, text), (2, None), (None, text)]}
        if name in first:
            assert got == sorted(first[name], key=str), name
        else:
            assert got


def test_oracles(spark):
    """The SQL of the operators that have one gives the queries' rows."""
    import duckdb

    from strataspark.llm import queries as Q

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{d}/documents.parquet'")
    for name, sql in Q.oracle_sql().items():
        df, rel = Q.queries()[name](spark, d), c.sql(sql)
        assert df.columns == rel.columns
        assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall()), name
