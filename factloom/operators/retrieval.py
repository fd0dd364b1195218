"""Batch hybrid retrieval: many queries at once over a chunk table, from period scope to the final ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numeric import rounded
from factloom.operators import bm25, fusion, scope, vector
from factloom.operators.windows import windows_of


def lexical_scorer(pairs: DataFrame) -> DataFrame:
    """Default scorer of (query_id, query, doc_id, window): the share of the query's distinct tokens that a window holds.
    A model takes its place as any function from pairs to pairs with ``score``, for instance a ``mapInPandas``."""
    asked = F.array_distinct(bm25.tokens(F.col("query")))
    return pairs.withColumn("score", F.try_divide(F.size(F.array_intersect(asked, bm25.tokens(F.col("window")))).cast("double"), F.size(asked).cast("double")))


#: Decimals that a retriever's score is compared with, so that equal texts tie whatever order their terms were summed in.
SCORE_DECIMALS = 6


def _by_ticker(queries: DataFrame, own, whole) -> DataFrame:
    """``own`` of the queries that name a ticker and ``whole`` of the others; neither runs without a query."""
    named, free = queries.where("ticker is not null"), queries.where("ticker is null")
    if free.isEmpty():
        return own(named)
    return whole(free) if named.isEmpty() else own(named).unionByName(whole(free))


def candidate_lists(chunks: DataFrame, queries: DataFrame, scopes: DataFrame, pool: int = fusion.POOL) -> DataFrame:
    """(query_id, retriever, doc_id, rank, label): what each retriever gives to the fusion, after ticker and period filters.

    A query with a ticker is scored in that ticker's own index. Dates filter scored rows, so they never touch statistics; they come
    along with the scores. The ``pool`` best inside and outside of the scope are cut in each task before anything is shuffled; both
    sets of lists come from them.
    """
    texts, dates = chunks.select("doc_id", "ticker", "text", "report_date"), ("report_date",)
    lexical = _by_ticker(queries, lambda q: bm25.bm25_own_part(texts, q.select("query_id", "query", "ticker"), "ticker", dates), lambda q: bm25.bm25_global(texts, q.select("query_id", "query"), dates))
    scoped = scopes.select("query_id", "report_dates", "reason")
    lexical = lexical.withColumn("score", rounded(F.col("score"), SCORE_DECIMALS)).where("score > 0").join(scoped, "query_id")
    lexical = lexical.withColumn("in_scope", F.coalesce(F.array_contains("report_dates", F.col("report_date")), F.lit(False)))
    lexical = bm25.top_n(lexical, pool, ["query_id", "in_scope"], positive=False).select("query_id", "doc_id", "score", "in_scope", "rank", F.lit("bm25").alias("retriever"))
    vectors = chunks.where("embedding is not null").select(F.col("doc_id").alias("vec_id"), "ticker", "embedding", F.col("report_date").cast("string").alias("report_date"))
    asked = queries.select("query_id", "ticker", "q").join(scoped.select("query_id", F.transform("report_dates", lambda d: d.cast("string")).alias("report_dates")), "query_id")
    dense = vector.vector_top(asked, vectors, pool, "ticker", ("report_dates", "report_date"))
    dense = dense.select("query_id", F.col("vec_id").alias("doc_id"), "score", "in_scope", "rank", F.lit("vector").alias("retriever"))
    return fusion.choose_lists(lexical.unionByName(dense).join(scoped.select("query_id", "reason"), "query_id"), pool)


def fused_pool(chunks: DataFrame, queries: DataFrame, calendars: DataFrame, pool: int = fusion.POOL) -> DataFrame:
    """(query_id, doc_id, fused_rank, fused_score, label): the pool of each query, the search without reranking.

    chunks (doc_id, ticker, form, report_date, text, embedding); queries (query_id, ticker or null, query, q); calendars
    (ticker, end_month). The label tells how the lists were chosen: dates, filtered_empty, no_match or no_date.
    """
    filings = scope.filing_list(chunks.withColumn("pos", F.col("doc_id")))
    scopes = scope.query_scopes(queries.select("query_id", "ticker", "query"), filings, calendars)
    lists = candidate_lists(chunks, queries, scopes, pool).withColumn("list_no", F.when(F.col("retriever") == "bm25", 0).otherwise(1))
    return fusion.fuse(lists, fusion.RRF_K, "label").select("query_id", "doc_id", "fused_rank", "fused_score", "label")


def hybrid_search(
    chunks: DataFrame, queries: DataFrame, calendars: DataFrame, top: int = fusion.TOP, pool: int = fusion.POOL, floor: int = fusion.FLOOR, scorer: Callable[[DataFrame], DataFrame] = lexical_scorer
) -> DataFrame:
    """(query_id, doc_id, final_rank, fused_rank, ce_rank, combined_score, rescued, label).

    Inputs as in ``fused_pool``, chunks with contains_table as well. The pool's texts, at most 2 x ``pool`` per query, are
    windowed and scored; a chunk counts with its best window.
    """
    fused = fused_pool(chunks, queries, calendars, pool)
    texts = fused.join(chunks.select("doc_id", "text", "contains_table"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    pairs = texts.select("query_id", "query", "doc_id", F.explode(windows_of(F.col("text"))).alias("window"))
    best = fusion.max_per_owner(scorer(pairs)).withColumnRenamed("score", "ce_score")
    marked = texts.withColumn("rescuable", fusion.is_rescuable(F.col("text"), F.col("contains_table"))).drop("text", "query")
    ranked = fusion.combine(marked.join(best, ["query_id", "doc_id"]), floor)
    final = fusion.rescue(ranked, top)
    return final.join(ranked.select("query_id", "doc_id", "fused_rank", "ce_rank", "combined_score", "label"), ["query_id", "doc_id"])
