"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, collocations, conversation_repair, html_main, line_dedup, mixing, near_dup, ogg, pii, secrets, token_counts, topk, toxicity
from factloom.llm.common import table

#: Folder of the public vocabulary files; every operator that needs one takes its path as a parameter.
VOCABULARIES = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    return f"{VOCABULARIES}/{name}"


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_texts(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_query(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")).drop("found")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_line_n").alias("n_lines"), F.col("_line_dropped").alias("n_dropped"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_column(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_main_text, op2_mixing, op3_secrets, op4_toxicity, op5_near_dup, op6_bpe, op7_line_dedup, op8_ogg, op9_exact_topk, op10_pii, op11_collocations, op12_token_counts, op13_conversation_repair)
}

TOPK_SQL = """
WITH q AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, a.r, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

NEAR_DUP_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * i >= 85 * (na + nb - i)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS seen FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.seen = e.a),
components AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN components c USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_mixing": mixing.mixing_sql(), "op5_near_dup": NEAR_DUP_SQL, "op9_exact_topk": TOPK_SQL, "op11_collocations": collocations.collocations_sql(), "op13_conversation_repair": conversation_repair.repair_sql()}
