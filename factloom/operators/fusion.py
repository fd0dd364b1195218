"""Fusing ranked lists: reciprocal ranks, the fused floor, and the rescue of a table that reranking pushed out.

All inputs are long tables with a query_id; a query's pool has at most some dozens of rows, so windows per query are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reciprocal rank constant, pool size, results, ranks of the floor, figures of a data table.
RRF_K = 60
POOL = 25
TOP = 5
FLOOR = 3
TABLE_DOLLARS = 5
TIE_SHARE = 1e-9


def reciprocal_rank_fusion(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, fused_score, fused_rank) of lists (query_id, doc_id, rank). Ties go to what was seen first: the
    earlier list, then the better rank in it."""
    rows = [df.select("query_id", "doc_id", "rank", F.lit(i).alias("list_no")) for i, df in enumerate(lists)]
    union = rows[0]
    for df in rows[1:]:
        union = union.unionByName(df)
    return fuse(union, k)


def fuse(lists: DataFrame, k: int = RRF_K, *also: str) -> DataFrame:
    """Like ``reciprocal_rank_fusion``, from one table (query_id, doc_id, rank, list_no); ``also`` names columns of the query to keep."""
    # terms are added in list order, so that the sum does not depend on the order of rows
    fused = lists.groupBy("query_id", *also, "doc_id").agg(F.array_sort(F.collect_list(F.struct("list_no", "rank"))).alias("seen"))
    fused = fused.withColumn("fused_score", F.aggregate("seen", F.lit(0.0), lambda s, x: s + 1.0 / (k + x["rank"])))
    order = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), F.col("seen")[0]["list_no"], F.col("seen")[0]["rank"])
    return fused.withColumn("fused_rank", F.row_number().over(order)).drop("seen")


def combine(pool: DataFrame, floor: int = FLOOR, k: int = RRF_K) -> DataFrame:
    """Adds ce_rank, combined_score and combined_rank to a pool (query_id, doc_id, fused_rank, ce_score)."""
    by_ce = Window.partitionBy("query_id").orderBy(F.col("ce_score").desc(), "fused_rank")
    ranked = pool.withColumn("ce_rank", F.row_number().over(by_ce))
    ce, fused = 1.0 / (k + F.col("ce_rank")), 1.0 / (k + F.col("fused_rank"))
    ranked = ranked.withColumn("combined_score", F.when(F.col("fused_rank") > floor, ce).otherwise(F.greatest(fused, ce) + TIE_SHARE * ce))
    return ranked.withColumn("combined_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("combined_score").desc(), "fused_rank")))


def is_rescuable(text, contains_table):
    return contains_table & (F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit(""))) >= TABLE_DOLLARS)


def rescue(ranked: DataFrame, top: int = TOP) -> DataFrame:
    """The final ``top`` rows of each query (query_id, doc_id, final_rank, rescued) from rows with combined_rank, fused_rank,
    contains_table and rescuable: if no table is among them, the best rescuable one of the pool's first half takes the
    last place."""
    query = Window.partitionBy("query_id")
    in_top = F.col("combined_rank") <= top
    marked = ranked.withColumn("_has_table", F.max(F.coalesce(in_top & F.col("contains_table"), F.lit(False))).over(query)).withColumn("_half", F.floor(F.count("*").over(query) / 2))
    fits = ~F.col("_has_table") & F.col("rescuable") & (F.col("fused_rank") <= F.col("_half")) & ~in_top
    marked = marked.withColumn("_swap", F.min(F.when(fits, F.col("fused_rank"))).over(query))
    rescued = F.coalesce(F.col("fused_rank") == F.col("_swap"), F.lit(False))
    # a pool smaller than ``top`` has no row outside the top, hence nothing to swap
    kept = marked.where(rescued | (in_top & (F.col("_swap").isNull() | (F.col("combined_rank") < top))))
    return kept.select("query_id", "doc_id", F.when(rescued, top).otherwise(F.col("combined_rank")).alias("final_rank"), rescued.alias("rescued"))


def max_per_owner(windows: DataFrame) -> DataFrame:
    """The best window score of each chunk (query_id, doc_id, score)."""
    return windows.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def choose_lists(candidates: DataFrame, n: int = POOL) -> DataFrame:
    """The n best rows of each query and retriever with rank and label: those in scope if any retriever has one, else all.

    candidates (query_id, reason of the scope, retriever, doc_id, score, in_scope), at least the n best of each kind.
    """
    query = Window.partitionBy("query_id")
    scoped = (F.col("reason") == "dates") & F.max("in_scope").over(query)
    label = F.when(F.col("reason") != "dates", F.col("reason")).when(scoped, "dates").otherwise("filtered_empty")
    labelled = candidates.withColumn("label", label)
    order = Window.partitionBy("query_id", "retriever").orderBy(F.col("score").desc(), "doc_id")
    kept = labelled.where((F.col("label") != "dates") | F.col("in_scope")).withColumn("rank", F.row_number().over(order))
    return kept.where(F.col("rank") <= n).select("query_id", "retriever", "doc_id", "rank", "label")
