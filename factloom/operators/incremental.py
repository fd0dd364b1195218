"""BM25 statistics that are kept up to date by what changes, and scores from a store that holds them.

Indexed rows carry their tokens and their length. The document frequencies and sizes of each part, and over all, are
tables of their own. An update adds the statistics of the rows that come and takes off those of the rows that go; nothing
else is read, so its cost follows the change and the vocabulary, not the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import bm25


def indexed(chunks: DataFrame) -> DataFrame:
    """Adds to chunks (text) their ``tokens`` and their length in tokens ``dl``."""
    return chunks.withColumn("tokens", bm25.tokens(F.coalesce("text", F.lit("")))).withColumn("dl", F.size("tokens").cast("long"))


def statistics(rows: DataFrame, part: str, sign: int = 1) -> dict[str, DataFrame]:
    """terms (part, term, n) and sizes (part, n_docs, total_length) of indexed rows; the sign is that of the counts."""
    terms = rows.select(part, F.explode(F.array_distinct("tokens")).alias("term")).groupBy(part, "term").agg((F.count("*") * sign).alias("n"))
    sizes = rows.groupBy(part).agg((F.count("*") * sign).alias("n_docs"), (F.sum("dl") * sign).alias("total_length"))
    return {"terms": terms, "sizes": sizes}


def maintained(part: str):
    """The function that a store's update calls: statistics so far, plus those of rows that come, minus those of rows that go."""

    def derive(before: dict[str, DataFrame], come: DataFrame, gone: DataFrame | None) -> dict[str, DataFrame]:
        changes = [statistics(come, part)] + ([statistics(gone, part, -1)] if gone is not None else [])
        out = {}
        for name, keys, sums in (("terms", [part, "term"], ["n"]), ("sizes", [part], ["n_docs", "total_length"])):
            tables = [*([before[name]] if before else []), *(c[name] for c in changes)]
            both = tables[0]
            for more in tables[1:]:
                both = both.unionByName(more)
            summed = both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
            out[name] = summed.where(F.col(sums[0]) != 0)
        return out

    return derive


def scores(rows: DataFrame, tables: dict[str, DataFrame], queries: DataFrame, part: str) -> DataFrame:
    """(query_id, part, doc_id, score): Lucene's form from maintained statistics; only the terms of the queries leave a row."""
    terms = bm25.query_terms(queries)
    averages = tables["sizes"].select(part, "n_docs", (F.col("total_length") / F.col("n_docs")).alias("avgdl"))
    asked = tables["terms"].join(terms.select("term").distinct(), "term").join(averages, part)
    idf = asked.select(part, "term", F.log(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"))
    sized = rows.select(part, "doc_id", F.col("tokens").alias("_tokens"), F.col("dl").alias("_dl"))
    postings = bm25.term_postings(sized, terms, [part])
    return bm25.scored(postings, idf, averages.drop("n_docs"), terms, [part])
