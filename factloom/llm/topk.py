"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates are dealt to blocks by hash and queries to groups; each pair of a block and a group is one task of bounded size. A
block keeps one list per dimension, sorted by component. For a query, every list is read from the end that its own
component favours; each vector met is scored in full (random access), and reading stops once the bound, the score of
a vector with the components at the lists' current positions, is below the kth best score. The best k of each block are
then merged by a window over (blocks x k) rows per query.

Components are taken as floor(scale * x) integers, so scores are exact and ties are real: they go to the smaller vec_id.

Nulls and edge cases: a vector that is null, empty or holds null or non-finite components takes no part, nor does one whose
vec_id is null; vectors of another length than the query have no score with it; if a vec_id repeats, each of its rows is a query
of its own, for which only that row itself is no candidate; fewer than k candidates give fewer rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint

BLOCK_ROWS = 8_192
GROUP_QUERIES = 8_192
#: List positions that are read between two looks at the bound.
STRIDE = 64


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, q) of the vectors that take part; q: floor(scale * x) as long."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(ok & F.col("vec_id").isNotNull()).select("vec_id", q.alias("q"))


class SortedLists:
    """One list per dimension over a block of candidates, each sorted by component, smallest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        self.ids, self.rows = ids, ids if rows is None else rows
        # sums of products below 2**24 are exact in single precision, below 2**53 in double
        exact = vectors.shape[1] * float(np.abs(vectors).max(initial=0)) ** 2 < 2**24
        self.vectors = vectors.astype(np.float32 if exact else np.float64)
        self.limit = 2**24 if exact else 2**53
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best without row ``own``, best first; ties to the smaller id."""
        if len(query) * float(np.abs(query).max(initial=0)) * float(np.abs(self.sorted).max(initial=0)) >= self.limit:
            self.vectors, self.limit = self.vectors.astype(np.float64), 2**53
        n, typed = len(self.ids), query.astype(self.vectors.dtype)
        up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        if not len(up) and not len(down):
            up = np.arange(1)
        unseen = self.rows != own
        left = int(unseen.sum())
        best_ids, best = np.empty(0, self.ids.dtype), np.empty(0, np.int64)
        lo, stride = 0, STRIDE
        while lo < n and left:
            hi = min(n, lo + stride)
            met = np.zeros(n, bool)
            met[self.order[up, lo:hi]] = True
            met[self.order[down, n - hi : n - lo]] = True
            met &= unseen
            rows = np.flatnonzero(met)
            unseen[rows] = False
            left -= len(rows)
            scores = (self.vectors[rows] @ typed).astype(np.int64)
            if len(best) == k:
                able = scores >= best[-1]
                rows, scores = rows[able], scores[able]
            if len(rows):
                ids, scores = np.concatenate([best_ids, self.ids[rows]]), np.concatenate([best, scores])
                if len(scores) > 8 * k:
                    able = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    ids, scores = ids[able], scores[able]
                keep = np.lexsort((ids, -scores))[:k]
                best_ids, best = ids[keep], scores[keep]
            if hi < n and len(best) == k:
                bound = self.sorted[up, hi - 1] @ query[up] + self.sorted[down, n - hi] @ query[down]
                if bound < best[-1]:  # at equality an unseen vector of a smaller id could still enter
                    break
            lo, stride = hi, 2 * stride
        return best_ids, best


def _search(k: int):
    def run(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            lists = SortedLists(candidates["vec_id"].to_numpy(), np.stack(candidates["q"].to_numpy()).astype(np.float64), candidates["row"].to_numpy())
            for own, row, q in zip(queries["vec_id"], queries["row"], queries["q"], strict=True):
                ids, scores = lists.top(np.asarray(q, np.float64), row, k)
                out += [(own, row, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every vector whose vec_id is divisible by ``every``."""
    q = checkpoint(quantised(vectors, scale).withColumn("row", F.monotonically_increasing_id()))  # fixed by the checkpoint
    rows = q.count()
    blocks, groups = max(1, -(-rows // BLOCK_ROWS)), max(1, -(-rows // (every * GROUP_QUERIES)))
    size = F.size("q").alias("size")
    candidates = q.select("vec_id", "row", "q", size, F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    queries = q.where(F.col("vec_id") % every == 0)
    queries = queries.select("vec_id", "row", "q", size, F.pmod(F.xxhash64("row", F.lit(2)), F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ("block", "group", "size")
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(_search(k), "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
