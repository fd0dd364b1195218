"""Exact cosine ordering of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_QUERIES = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_scores(queries: DataFrame, vectors: DataFrame, part: str | None = None) -> DataFrame:
    """(query_id, vec_id, score): cosine of each query (query_id, q) with every vector (vec_id, embedding); with ``part``, a
    column of both sides, with the vectors of the query's own part alone.

    Queries are gathered into blocks of about ``BLOCK_QUERIES``; a vector meets a block as one row and its queries inside it,
    by an equi-join on the block's number, so neither side is broadcast whatever its size.
    """
    keys = [part] if part else []
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    length = lambda c: F.sqrt(dot(F.col(c), F.col(c)))  # noqa: E731 - once a vector, not once a pair
    held = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy(*keys, "_block").agg(F.collect_list(F.struct("query_id", "q", length("q").alias("n"))).alias("_queries"))
    dealt = vectors.select(*keys, "vec_id", "embedding", length("embedding").alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    pairs = dealt.join(held, [*keys, "_block"]).select("vec_id", "embedding", "_n", F.explode("_queries").alias("x"))
    return pairs.select("x.query_id", "vec_id", F.try_divide(dot(F.col("x.q"), F.col("embedding")), F.col("x.n") * F.col("_n")).alias("score"))


#: Rows of a block of vectors that meets a block of queries in one task.
BLOCK_VECTORS = 8_192


def vector_top(queries: DataFrame, vectors: DataFrame, n: int, part: str | None = None, scope: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the n best vectors (vec_id, embedding) of each query (query_id, q), by cosine to six decimals, ties
    to the smaller vec_id; vectors and queries without a direction take no part.

    With ``part``, a column of both sides, a query that names one sees the vectors of that part alone, one without sees all. With
    ``scope``, (column of the queries with an array of values, column of the vectors), there are two lists, ``in_scope`` or
    not, of n each. Blocks of vectors meet blocks of queries, and only each block's best leave it: rows are queries x blocks x n,
    never queries x vectors.
    """
    size = max(1, -(-vectors.count() // BLOCK_VECTORS))
    groups = max(1, -(-queries.count() // BLOCK_QUERIES))
    asked = queries.select("query_id", "q", *([F.col(part).alias("_part")] if part else []), *([F.col(scope[0]).alias("_scope")] if scope else []))
    held = vectors.select("vec_id", "embedding", *([F.col(part).alias("_part")] if part else []), *([F.col(scope[1]).alias("_value")] if scope else []))
    asked = asked.withColumns({"_group": F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"), "_block": F.explode(F.sequence(F.lit(0), F.lit(size - 1)))})
    held = held.withColumns({"_block": F.pmod(F.xxhash64("vec_id"), F.lit(size)).cast("int"), "_group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        held = held[[x is not None and len(x) > 0 for x in held["embedding"]]]
        if len(asked) and len(held):
            ids, matrix = held["vec_id"].to_numpy(), np.stack([np.asarray(x, np.float64) for x in held["embedding"]])
            lengths = np.sqrt((matrix * matrix).sum(axis=1))
            for row in asked.to_dict("records"):
                q = np.asarray(row["q"], np.float64)
                with np.errstate(all="ignore"):
                    scores = np.floor((matrix @ q) / (np.sqrt(q @ q) * lengths) * 1e6 + 0.5) / 1e6
                able = np.isfinite(scores)
                if part and row["_part"] is not None:
                    able &= (held["_part"] == row["_part"]).to_numpy()
                inside = held["_value"].isin([] if row["_scope"] is None else list(row["_scope"])).to_numpy() if scope else np.zeros(len(ids), bool)
                for wanted in (False, True) if scope else (False,):
                    at = np.flatnonzero(able & (inside == wanted))
                    order = np.lexsort((ids[at], -scores[at]))[:n]
                    out += [(row["query_id"], ids[at[i]], scores[at[i]], wanted) for i in order]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "in_scope"])

    kind = queries.schema["query_id"].dataType.simpleString()
    found = asked.groupBy("_block", "_group").cogroup(held.groupBy("_block", "_group")).applyInPandas(best, f"query_id {kind}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double, in_scope boolean")
    window = Window.partitionBy("query_id", "in_scope").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
    return found if scope else found.drop("in_scope")
