"""An index over the documents that is kept up to date, and a filterable vector index over the embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numeric import rounded
from factloom.operators import bm25, corpus, incremental, vector_index
from factloom.plans.retrieval_queries import _BASE, _queries
from factloom.sources.shared import new_folder
from factloom.sources.store import ChunkStore
from factloom.sources.tables import table

RECIPE = {"tokens": bm25.TOKEN, "version": 1}


def _corpus(spark: SparkSession, sf_dir: str, after: bool) -> tuple[DataFrame, DataFrame]:
    """(chunks, files) before and after a change: each document is a file; one source is new, one is gone, one language was edited."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("relpath"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("accession"), "lang", "source", "text")
    if after:
        docs = docs.where("source is null or source <> 'src5'").withColumn("text", F.when(F.col("lang") == "fr", F.concat(F.coalesce("text", F.lit("")), F.lit(" license"))).otherwise(F.col("text")))
    else:
        docs = docs.where("source is null or source <> 'src3'")
    return docs.drop("source"), corpus.manifest(docs.withColumnRenamed("text", "content"))


def _prepared(chunks: DataFrame) -> DataFrame:
    """What the index holds of a chunk: its tokens and its text's digest."""
    return incremental.indexed(chunks).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).drop("text")


def _updated(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """A store that was built over the documents before the change and updated to those after it."""
    store = ChunkStore(spark, new_folder(spark, "store"))
    for after in (False, True):
        chunks, files = _corpus(spark, sf_dir, after)
        store.update(chunks, files, RECIPE, "after" if after else "before", incremental.maintained("lang"), _prepared)
    return store


def index_update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows after an update, and the version that each came with: unchanged documents are those of the first."""
    return _updated(spark, sf_dir).rows().select("doc_id", "dl", "sha", F.col("_version").alias("version"))


def index_update_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies that the update has kept up to date from what came and went."""
    return _updated(spark, sf_dir).tables()["terms"]


def bm25_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents per language after the update, with the maintained statistics."""
    store = _updated(spark, sf_dir)
    scores = incremental.scores(store.rows(), store.tables(), _queries(spark), "lang").withColumn("score", rounded(F.col("score"), 6))
    return bm25.top_n(scores, 10, ["query_id", "lang"]).select("query_id", "lang", "rank", "doc_id", "score")


FILTERS = ("ticker", "report_date")
K = 10


#: Vectors on which the index measures how much a search has to read, about.
CALIBRATION = 100


def _date(n) -> Column:
    return F.last_day(F.add_months(F.lit("1996-03-01").cast("date"), (n % 8 * 3).cast("int"))).cast("string")


def _asked(vectors: DataFrame, kind: Column) -> DataFrame:
    """Vectors as queries: of kind 0 without a filter, of kind 1 in their own ticker, of kind 2 in their own ticker and two dates."""
    dates = F.array(_date(F.col("vec_id")), _date(F.col("vec_id") + 1))
    return vectors.withColumn("_kind", kind).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.when(F.col("_kind") > 0, F.array("ticker")).alias("f_ticker"), F.when(F.col("_kind") == 2, dates).alias("f_report_date"),
        F.when(F.col("_kind") == 0, "none").when(F.col("_kind") == 1, "ticker").otherwise("ticker and dates").alias("filter"),
    )


def _index(spark: SparkSession, sf_dir: str) -> tuple[vector_index.VectorIndex, dict[int, float], DataFrame]:
    """(index, shares to read, queries): labels are tickers and ids give dates; every vector whose id is divisible by 100 asks."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("ticker"), _date(F.col("vec_id")).alias("report_date"))
    index = vector_index.VectorIndex.build(vectors, FILTERS)
    spread = max(1, vectors.count() // CALIBRATION)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(spread)) == 0)
    shares = index.calibrated(_asked(sample, F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(3))), K)
    return index, shares, _asked(vectors.where("vec_id % 100 = 0"), F.floor(F.col("vec_id") / 100) % 3)


def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest that the index finds, with their filters."""
    index, shares, queries = _index(spark, sf_dir)
    return index.search(queries, K, shares).withColumn("score", rounded(F.col("score"), 6))


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of filter, whether the index finds nine of ten of the exact results."""
    index, shares, queries = _index(spark, sf_dir)
    exact = index.search(queries, K, 1.0).join(queries.select("query_id", "filter"), "query_id")
    return vector_index.recall(index.search(queries, K, shares), exact, "filter").select("filter", "n_queries", "n_exact", (F.col("recall") >= 0.9).alias("enough"))


QUERIES = {f.__name__: f for f in (index_update_rows, index_update_statistics, bm25_from_index, vector_index_search, vector_index_recall)}

_AFTER = """(SELECT doc_id, source, lang, n_chars, CASE WHEN lang = 'fr' THEN coalesce(text, '') || ' license' ELSE text END AS text FROM documents WHERE source IS NULL OR source <> 'src5')"""

ORACLES = {
    "index_update_rows": f"""SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::BIGINT AS dl, sha256(coalesce(text, '')) AS sha, CASE WHEN lang = 'fr' OR source = 'src3' THEN 2 ELSE 1 END::BIGINT AS version FROM {_AFTER}""",
    "index_update_statistics": f"""SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS term FROM {_AFTER}) GROUP BY 1, 2""",
    "bm25_from_index": f"""WITH {_BASE.replace("FROM documents)", f"FROM {_AFTER})", 1)}, g AS (SELECT lang, count(*) AS big_n, avg(len(toks)) AS avgdl FROM docs GROUP BY 1), df AS (SELECT lang, term, count(*) AS n FROM post GROUP BY 1, 2),
s AS (SELECT query_id, p.lang, doc_id, floor(sum(weight * ln(1 + (big_n - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * 1e6 + 0.5) / 1e6 AS score
  FROM post p JOIN terms USING (term) JOIN df ON df.lang = p.lang AND df.term = p.term JOIN g ON g.lang = p.lang GROUP BY 1, 2, 3)
SELECT query_id, lang, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "vector_index_recall": f"""WITH q AS (SELECT vec_id, label, vec_id // 100 % 3 AS kind FROM embeddings WHERE vec_id % 100 = 0),
n AS (SELECT q.vec_id, kind, least({K}, count(*)) AS n FROM q JOIN embeddings e ON kind = 0 OR (e.label = q.label AND (kind = 1 OR e.vec_id % 8 IN (q.vec_id % 8, (q.vec_id + 1) % 8))) GROUP BY 1, 2)
SELECT CASE kind WHEN 0 THEN 'none' WHEN 1 THEN 'ticker' ELSE 'ticker and dates' END AS filter, count(*) AS n_queries, sum(n)::BIGINT AS n_exact, true AS enough FROM n GROUP BY 1""",
}
