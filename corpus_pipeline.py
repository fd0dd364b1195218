"""A training corpus from ``documents``: toxic documents go, recurring lines go, one document of each group of near
duplicates stays, sources are mixed to their target weights, and the texts that remain are tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of ``documents``; ``n_chars`` follows the text. A row whose
text is null passes through all filters; the last stage counts it as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, catalog, line_dedup, mixing, near_dup, toxicity
from factloom.llm.common import checkpoint, ensure_checkpoint_dir, small_side, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 4 predicts as toxic go; its labels come from the labels table."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.filtered(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go (operator 7)."""
    cleaned = line_dedup.deduplicated_lines(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("_line_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (operator 5): the one with the smallest doc_id."""
    gone = checkpoint(near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(small_side(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet their target weights (operator 2)."""
    return mixing.mixed(docs).where("_mix_kept").select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts (operator 6)."""
    return bpe.bpe_round_trip(docs, catalog.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: Trained scores and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with their results written under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    base = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
