"""The training-data operators as queries over whole tables, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrain.llm.bpe import encode_documents
from lexigrain.llm.exact_dedup import exact_duplicates
from lexigrain.llm.ngram_join import near_documents
from lexigrain.llm.nn_descent import near_embeddings
from lexigrain.llm.packing import pack_documents
from lexigrain.llm.page_diff import extract_text
from lexigrain.llm.quality import score_quality
from lexigrain.llm.substring_dedup import repeated_passages
from lexigrain.llm.suffix_dedup import suffix_repeats
from lexigrain.llm.toxicity import toxic_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(_table(spark, sf_dir, "embeddings"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"))


_COPIES = """
SELECT doc_id, keep_doc_id, copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_doc_id, count(*) OVER (PARTITION BY text) AS copies
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
WHERE doc_id <> keep_doc_id
"""

_PASSAGES = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS s FROM w WHERE len(ws) >= 50),
h AS (SELECT DISTINCT doc_id, s, array_to_string(ws[s + 1:s + 50], ' ') AS t FROM g),
r AS (SELECT doc_id, s, count(*) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1 AS removed FROM h),
i AS (SELECT doc_id, s, removed, CASE WHEN s <= lag(s) OVER p + 50 THEN 0 ELSE 1 END AS fresh FROM r WHERE n > 1 WINDOW p AS (PARTITION BY doc_id, removed ORDER BY s)),
j AS (SELECT doc_id, s, removed, sum(fresh) OVER (PARTITION BY doc_id, removed ORDER BY s) AS span FROM i)
SELECT doc_id, min(s) AS start_word, max(s) + 50 AS end_word, removed FROM j GROUP BY doc_id, removed, span
"""


_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[s:s + 2], ' ') END AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS s FROM w WHERE len(ws) > 0)),
f AS (SELECT doc_id, gram, count(*) OVER (PARTITION BY doc_id) AS size, count(*) OVER (PARTITION BY gram) AS df FROM g),
q AS (SELECT doc_id, gram, size, count(*) OVER (PARTITION BY doc_id) AS shared FROM f WHERE df > 1),
o AS (SELECT doc_id, gram, size FROM q WHERE shared >= 0.4 * size - 1e-9),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS overlap FROM o a JOIN o b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
j AS MATERIALIZED (SELECT a, b FROM p WHERE overlap >= 0.4 * (sa + sb - overlap) - 1e-9),
r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM j UNION SELECT r.doc_id, j.b FROM r JOIN j ON j.a = r.reached),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM j GROUP BY a)
SELECT doc_id, min(reached) AS class_id, any_value(n_links) AS n_links FROM r JOIN l USING (doc_id) GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_exact_dedup, op3_substring_dedup, op4_best_fit_packing, op5_quality_classifier, op6_ngram_jaccard_join, op7_embedding_near_dedup, op8_suffix_array_dedup, op9_toxicity, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _COPIES, "op3_substring_dedup": _PASSAGES, "op6_ngram_jaccard_join": _NEAR, "op8_suffix_array_dedup": _PASSAGES}
