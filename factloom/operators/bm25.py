"""BM25 over a collection, with statistics per partition of it or over all of it.

Only postings of query terms leave the documents: the terms of all queries come as one row, each document's token array is
cut down to them, and lengths are array sizes, so no shuffle moves tokens or texts. Statistics come from the whole partition,
never from filtered candidates. Small sides are left to the optimiser; only single rows are marked for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.shared import small_side, written

K1 = 1.5
B = 0.75
#: Share of the mean inverse document frequency that replaces negative ones in the Okapi form.
NEGATIVE_SHARE = 0.25
TOKEN = "[a-z0-9]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) of queries (query_id, query); a repeated term counts as often as it stands there."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))


def _lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_tokens", tokens(F.coalesce("text", F.lit("")))).withColumn("_dl", F.size("_tokens"))


def scored(postings: DataFrame, idf: DataFrame, averages: DataFrame, terms: DataFrame, part: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("_dl") / F.col("avgdl"))
    gain = F.col("weight") * F.col("idf") * tf * (K1 + 1) / (tf + norm)
    joined = postings.join(terms, [c for c in terms.columns if c in (*part, "term")]).join(idf, [*part, "term"])
    joined = joined.join(averages, part) if part else joined.crossJoin(F.broadcast(averages))  # one row
    return joined.groupBy("query_id", *part, "doc_id", *carry).agg(F.sum(gain).alias("score"))


def term_postings(docs: DataFrame, terms: DataFrame, part: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(part, doc_id, carried columns, term, tf, _dl) of the query terms only. Counting happens inside each document's token array."""
    wanted = terms.agg(F.collect_set("term").alias("_wanted"))  # one row: the terms of the queries
    hit = docs.crossJoin(F.broadcast(wanted)).withColumn("_hit", F.array_intersect("_tokens", "_wanted")).where(F.size("_hit") > 0)
    each = hit.select(*part, "doc_id", *carry, "_dl", "_tokens", F.explode("_hit").alias("term"))
    return each.select(*part, "doc_id", *carry, "_dl", "term", F.size(F.filter("_tokens", lambda t: t == F.col("term"))).alias("tf"))


def bm25_by_partition(docs: DataFrame, queries: DataFrame, part: str) -> DataFrame:
    """Scores with Lucene's idf, ``ln(1 + (N - n + .5) / (n + .5))``, all statistics from one partition.

    docs (doc_id, text, part); queries (query_id, query). Documents without a query term have no row.
    """
    terms, sized = query_terms(queries), _lengths(docs)
    averages = sized.groupBy(part).agg(F.count("*").alias("n_docs"), F.avg("_dl").alias("avgdl"))
    postings = term_postings(sized, terms, [part])
    df = postings.groupBy(part, "term").agg(F.count("*").alias("n"))
    idf = df.join(averages, part).select(part, "term", F.log(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"))
    return scored(postings, idf, averages, terms, [part])


def _okapi(docs: DataFrame, terms: DataFrame, part: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Okapi scores with the statistics of each part, or of the whole collection without one."""
    sized = _lengths(docs)
    with_statistics = lambda df, one: df.join(one, part) if part else df.crossJoin(F.broadcast(one))  # noqa: E731 - one row
    averages = sized.groupBy(*part).agg(F.count("*").alias("n_docs"), F.avg("_dl").alias("avgdl"))
    vocabulary = sized.select(*part, F.explode(F.array_distinct("_tokens")).alias("term")).groupBy(*part, "term").agg(F.count("*").alias("n"))
    with_idf = lambda df: with_statistics(df, averages).withColumn("raw", F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    # a mean of millions of doubles drifts with the order of adding, far enough to move rounded scores: each frequency is taken once, sums are decimal
    by_n = with_idf(vocabulary.groupBy(*part, "n").agg(F.count("*").alias("_terms")))
    total = F.sum((F.col("raw") * F.col("_terms")).cast("decimal(38,15)")).cast("double")
    floor = by_n.groupBy(*part).agg((total / F.sum("_terms") * NEGATIVE_SHARE).alias("floor"))
    own = with_statistics(with_idf(vocabulary.join(terms.select(*part, "term").distinct(), [*part, "term"])), floor)
    idf = own.select(*part, "term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return scored(term_postings(sized, terms, part, carry), idf, averages, terms, part, carry)


def bm25_global(docs: DataFrame, queries: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Scores with Okapi's idf over the whole collection; negative ones become a quarter of the mean over the vocabulary. Columns of
    docs that ``carry`` names come along, so that scored rows need no join for them."""
    return _okapi(docs, query_terms(queries), [], carry)


def bm25_own_part(docs: DataFrame, queries: DataFrame, part: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Okapi scores of queries (query_id, query, part) in the one part of docs (doc_id, text, part) that each names: an index of
    its own per part, whose statistics no other part touches. Only parts that a query names are read further than the filter."""
    terms = query_terms(queries).join(queries.select("query_id", part), "query_id")
    parts = written(queries.select(part).distinct(), "parts")
    # a part's texts would all meet in one task if documents were shuffled by part; the parts that queries name are few beside them
    asked = docs.join(small_side(parts, parts.count()), part, "left_semi")
    return _okapi(asked, terms, [part], carry).select("query_id", "doc_id", *carry, "score")


def top_n(scores: DataFrame, n: int, keys: list[str], position: str = "doc_id", positive: bool = True) -> DataFrame:
    """The n best of each key with their 1-based rank; ties go to the earlier position, scores of 0 or less are cut if ``positive``."""
    window = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(position))
    return (scores.where("score > 0") if positive else scores).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
