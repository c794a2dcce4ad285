"""Thin queries over the whole tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import decontaminate
from .fingerprints import edited_fingerprints
from .katz import katz_scores
from .language_id import identify
from .license_scan import scan_licenses
from .line_dedup import line_dedup
from .mixing import mix_sources
from .ngram_join import ngram_join
from .quality import quality
from .substring_dedup import substring_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_read(spark, sf_dir, "documents"), 4, 85)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_read(spark, sf_dir, "documents"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold(5) == 0, F.lit(False))
    found = identify(docs.select("doc_id", "text"), docs.filter(~held_out).select("lang", "text"), spans=True)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(_read(spark, sf_dir, "documents"), _fold(7) == 2)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold(5) == 0, F.lit(False))
    labels = _read(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    return quality(docs, docs.filter(~held_out), labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_WORD = r"'[^\x20\x09-\x0D]+'"

#: All pairs that share a shingle, counted; components by reaching out from every document.
OP1 = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS x FROM t),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT s.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) m ON s.doc_id = m.doc_id"""

OP7 = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM i),
f AS (SELECT k, min(doc_id) AS least FROM k GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS at FROM k JOIN f USING (k) WHERE doc_id > least),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM t),
g AS (SELECT a.doc_id, count(c.at) AS n_removed, string_agg(word, ' ' ORDER BY a.at) FILTER (c.at IS NULL) AS kept FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.at = c.at GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN g ON t.doc_id = g.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator's rows; the others are tested against brute force, round trips or held-out accuracy."""
    return {"op1_ngram_jaccard_join": OP1, "op7_substring_dedup": OP7}
