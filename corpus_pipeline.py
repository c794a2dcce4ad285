"""A corpus pipeline over the documents table: five stages, each written as Parquet and read again as the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  Stages judge whole texts of all documents that their
predecessor kept, and act on what they find; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm.common import drop, written
from strataspark.llm.decontamination import decontaminate
from strataspark.llm.language_id import identify
from strataspark.llm.line_dedup import line_dedup
from strataspark.llm.mixing import mix_sources
from strataspark.llm.ngram_join import ngram_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (no language) go; of the rest a null lang becomes the predicted one.

    Without any lang to learn from there is no prediction: nulls stay, and so do all documents with a letter.
    """
    found = identify(docs, docs.select("lang", "text"), carry=("text", "lang", "source", "n_chars"), letters=True)
    known = F.when(F.col("lang_pred") != "und", F.col("lang_pred"))
    return found.filter("has_letter").withColumn("lang", F.coalesce("lang", known)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; a document that loses all its words goes too. Null texts, and rows with a null or repeated doc_id, are judged as rows of their own."""
    out = line_dedup(docs.select(*COLUMNS), percent=80)
    left = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _lengths(left)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Rows that share a doc_id are one document: it goes if any of them has a
    smaller doc_id in its component, else equal rows of it become one.  Rows
    with a null doc_id stay.
    """
    found = ngram_join(docs, 5, 80)
    ids = written(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("least")).filter("n > 1 or least < doc_id"), "groups")
    kept = docs.join(ids.filter("least < doc_id").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    several = ids.filter("n > 1").select("doc_id")
    if several.isEmpty():
        return kept
    return kept.join(several, "doc_id", "left_anti").select(*COLUMNS).unionByName(kept.join(several, "doc_id", "left_semi").select(*COLUMNS).dropDuplicates())


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null doc_id or text stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = decontaminate(docs, items).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the number of copies that the mix takes of it (those of none go)."""
    out = mix_sources(docs, carry=("text", "lang", "n_chars"))
    return out.filter("copies > 0").select(*COLUMNS, "size", "copies", "taken", "source_size", "target")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]

#: SQL can't express the stages (a trained model, set joins, a dual solved by iteration); tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return docs
