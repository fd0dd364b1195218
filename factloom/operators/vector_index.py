"""An approximate vector index with filters: inverted lists around centres.

Centres are fitted on a bounded sample (``SAMPLE`` rows, taken by hash); every row is then put into the list of its nearest
centre. A search reads the lists nearest to the query until they hold a stated share of the rows that pass the query's filter, so
a selective filter reads more lists, down to all of them where few rows pass, and never comes back short. Filters are applied
inside the lists, before the k best are cut. How large the share must be depends on how the vectors cluster: ``calibrated``
measures it against exact results of a bounded sample of queries, and with a share of 1 the search itself is exact.

Scale. Lists are cut into chunks of about ``CHUNK`` rows and queries into blocks, so a list that holds a third of all rows, as
copies of one vector would, is many groups of bounded size. Only the centres (``MOST_LISTS`` at most) travel to every task. Each
group returns k rows a query.

Vectors that are null, empty, without length, or hold null or non-finite components take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.shared import written

SAMPLE = 100_000
MOST_LISTS = 4_096
#: Rows of a chunk of a list, and queries of a block, that meet in one group.
CHUNK = 8_192
BLOCK_QUERIES = 4_096
#: Share of the rows that pass a filter, and rows for each wanted one, that a search reads at least.
SHARE = 0.2
ROWS_EACH = 50


def unit_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` with ``column`` replaced by ``unit``, its direction; rows without one are left out."""
    ok = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sized = vectors.where(ok).withColumn("_length", length).where("_length > 0")
    return sized.withColumn("unit", F.transform(column, lambda x: x.cast("double") / F.col("_length"))).drop("_length", column)


def fitted(units: DataFrame, rows: int, lists: int | None = None, seed: int = 1) -> np.ndarray:
    """Centres, one a row and of length 1, fitted on about ``SAMPLE`` of the ``rows`` (vec_id, unit) at most."""
    part = min(1.0, SAMPLE / max(rows, 1))
    sample = units.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < int(part * (1 << 20)) if part < 1 else F.lit(True))
    lists = lists or max(1, min(MOST_LISTS, int(rows**0.5), int(rows * part) // 10))
    model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=10).fit(sample.select(array_to_vector("unit").alias("features")))
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def assigned(units: DataFrame, centres: np.ndarray) -> DataFrame:
    """``units`` (unit and any other columns) with the number of the nearest centre's ``list``."""
    held = units.sparkSession.sparkContext.broadcast(centres)
    schema = units.select("*", F.lit(0).alias("list")).schema

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.argmax(_matrix(batch["unit"]) @ held.value.T, axis=1) if batch.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "list"])

    return units.mapInArrow(nearest, schema)


@dataclass
class VectorIndex:
    """``rows`` (vec_id, unit, list, chunk and the filter columns), ``sizes`` (list, filter columns, n) and centres."""

    centres: np.ndarray
    rows: DataFrame
    sizes: DataFrame
    filters: tuple[str, ...]

    @classmethod
    def build(cls, vectors: DataFrame, filters: tuple[str, ...] = (), lists: int | None = None) -> VectorIndex:
        """Index of vectors (vec_id, embedding, filter columns); written to the shared folder."""
        units = written(unit_vectors(vectors.select("vec_id", "embedding", *filters)), "units")
        rows = units.count()
        if not rows:
            return cls(np.empty((0, 0)), units.withColumns({"list": F.lit(0), "chunk": F.lit(0)}), units.groupBy(*filters).agg(F.count("*").alias("n")).withColumn("list", F.lit(0)), filters)
        centres = fitted(units.select("vec_id", "unit"), rows, lists)
        return cls.of(assigned(units, centres), centres, filters)

    @classmethod
    def of(cls, listed: DataFrame, centres: np.ndarray, filters: tuple[str, ...] = ()) -> VectorIndex:
        """Index of rows that have their list already, for instance those of a store after an update."""
        counts = listed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
        dealt = listed.join(F.broadcast(counts), "list")  # MOST_LISTS rows at most
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("_chunks")).cast("int")).drop("_chunks")
        rows = written(dealt.repartitionByRange("list", "chunk").sortWithinPartitions("list", "chunk"), "lists")
        return cls(centres, rows, written(rows.groupBy("list", *filters).agg(F.count("*").alias("n")), "sizes"), filters)

    def save(self, path: str) -> None:
        self.rows.write.parquet(f"{path}/rows")
        self.sizes.write.parquet(f"{path}/sizes")
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, c) for i, c in enumerate(self.centres.tolist())], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark: SparkSession, path: str, filters: tuple[str, ...] = ()) -> VectorIndex:
        centres = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # MOST_LISTS rows at most
        return cls(np.array([r.centre for r in centres]), spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/sizes"), filters)

    def _reach(self, queries: DataFrame) -> DataFrame:
        """(query_id, list, before, total): the lists with rows that pass a query's filter, how many of these rows nearer lists
        hold, and how many there are."""
        key = F.xxhash64(*(F.to_json(F.array(f"f_{f}")) for f in self.filters)) if self.filters else F.lit(0)
        wanted = queries.select(*(f"f_{f}" for f in self.filters)).distinct().withColumn("_filter", key)
        passes = F.lit(True)
        for f in self.filters:
            passes = passes & (F.col(f"f_{f}").isNull() | F.coalesce(F.array_contains(f"f_{f}", F.col(f)), F.lit(False)))
        counted = wanted.join(self.sizes, passes).groupBy("_filter", "list").agg(F.sum("n").alias("n"))  # distinct filters x list sizes
        held = counted.groupBy("_filter").agg(F.map_from_entries(F.collect_list(F.struct("list", "n"))).alias("_held"))
        centres = self.rows.sparkSession.sparkContext.broadcast(self.centres)

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                nearest = np.argsort(-(_matrix(batch["q"]) @ centres.value.T), axis=1, kind="stable")
                for at, (near, held) in enumerate(zip(nearest, batch["_held"].to_pylist(), strict=True)):
                    n = np.zeros(len(near), np.int64)
                    for i, rows in held:
                        n[i] = rows
                    lists = near[n[near] > 0]
                    before = np.cumsum(n[lists]) - n[lists]
                    columns = [batch["query_id"].take(pa.array([at] * len(lists), pa.int32())), pa.array(lists, pa.int32()), pa.array(before), pa.array(np.full(len(lists), n.sum()))]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "list", "before", "total"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.withColumn("_filter", key).join(held, "_filter").select("query_id", "q", "_held").mapInArrow(order, f"query_id {kind}, list int, before long, total long")

    def _asks(self, queries: DataFrame) -> DataFrame:
        return unit_vectors(queries.select("query_id", "q", *(f"f_{f}" for f in self.filters)), "q").withColumnRenamed("unit", "q")

    def _pattern(self) -> Column:
        """Which filters a query names, as one number."""
        out = F.lit(0)
        for i, f in enumerate(self.filters):
            out = out + F.when(F.col(f"f_{f}").isNotNull(), 1 << i).otherwise(0)
        return out

    def calibrated(self, queries: DataFrame, k: int, target: float = 0.95) -> dict[int, float]:
        """Shares that a search has to read so that ``target`` of the exact results of these queries lie in its lists, for each
        pattern of filters. Queries as in ``search``; each is compared with every row once, so give a bounded sample."""
        asked = self._asks(queries).withColumn("pattern", self._pattern())
        exact = written(self.search(queries, k, 1.0).select("query_id", "vec_id"), "exact")
        placed = exact.join(self.rows.select("vec_id", "list"), "vec_id").join(self._reach(asked), ["query_id", "list"]).join(asked.select("query_id", "pattern"), "query_id")
        needed = F.percentile(F.col("before") / F.col("total"), F.lit(target)).alias("share")
        return {r.pattern: min(1.0, r.share + 0.01) for r in placed.groupBy("pattern").agg(needed).collect()}

    def search(self, queries: DataFrame, k: int, share: float | dict[int, float] = SHARE) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k best that are found for queries (query_id, q and, for each filter column c,
        ``f_c``: an array of the values that pass, or null for all). query_id must be unique. ``share``: of the rows that pass the
        filter, what is read at least; 1 reads all lists, so results are exact; a dict gives it for each pattern of filters."""
        filters, kind = self.filters, queries.schema["query_id"].dataType.simpleString()
        units = self._asks(queries)
        blocks = max(1, -(-units.count() // BLOCK_QUERIES))
        shares = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[self._pattern()] if isinstance(share, dict) and share else F.lit(share or SHARE)
        asked = units.withColumn("_share", F.coalesce(shares.cast("double"), F.lit(SHARE)))
        read = F.col("before") < F.greatest(F.col("total") * F.col("_share"), F.lit(k * ROWS_EACH))
        lists = self._reach(units).join(asked.select("query_id", "_share"), "query_id").where(read).select("query_id", "list")
        chunks = self.rows.groupBy("list").agg((F.max("chunk") + 1).alias("_chunks"))
        probes = lists.join(F.broadcast(chunks), "list").select("query_id", "list", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"))  # MOST_LISTS rows at most
        probes = units.join(probes, "query_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        rows = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def best(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(found):
                ids, matrix = found["vec_id"].to_numpy(), np.stack(found["unit"].to_numpy())
                for _, query in asked.iterrows():
                    keep = np.ones(len(ids), bool)
                    for f in filters:
                        if query[f"f_{f}"] is not None:
                            keep &= found[f].isin(list(query[f"f_{f}"])).to_numpy()
                    at = np.flatnonzero(keep)
                    scores = matrix[at] @ np.asarray(query["q"])
                    if len(at) > k:
                        able = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                        at, scores = at[able], scores[able]
                    order = np.lexsort((ids[at], -scores))[:k]
                    out += [(query["query_id"], ids[at[i]], scores[i]) for i in order]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        keys = ("list", "chunk", "block")
        hits = probes.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(best, f"query_id {kind}, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame, by: str | None = None) -> DataFrame:
    """Share of the exact results that were found; for each value of ``by``, a column of ``exact``, if given."""
    hits = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("_hit")), ["query_id", "vec_id"], "left")
    return hits.groupBy(*([by] if by else [])).agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
