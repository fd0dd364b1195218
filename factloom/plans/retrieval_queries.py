"""Retrieval operators on the documents, with lang as the partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numeric import rounded
from factloom.operators import bm25, fusion, scope, vector, windows
from factloom.operators.retrieval import fused_pool, hybrid_search, lexical_scorer
from factloom.sources.tables import table

QUESTIONS = (("q1", "licensed under the Apache License version"), ("q2", "the and of in to"), ("q3", "password token secret api"))


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id string, query string")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def bm25_topk_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = bm25.bm25_by_partition(_documents(spark, sf_dir), _queries(spark), "lang").withColumn("score", rounded(F.col("score"), 6))
    return bm25.top_n(scores, 10, ["query_id", "lang"]).select("query_id", "lang", "rank", "doc_id", "score")


def bm25_topk_global_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = bm25.bm25_global(_documents(spark, sf_dir), _queries(spark)).withColumn("score", rounded(F.col("score"), 6))
    return bm25.top_n(scores, 25, ["query_id"]).select("query_id", "rank", "doc_id", "score")


def bm25_term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every term per language and over all, from one pass with grouping sets."""
    tokens = _documents(spark, sf_dir).select("lang", F.explode(F.array_distinct(bm25.tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    sets = tokens.rollup("term", "lang").agg(F.count("*").alias("n"), F.grouping("lang").alias("over_all"), F.grouping("term").alias("no_term"))
    return sets.where("no_term = 0").select("term", F.when(F.col("over_all") == 1, "*").otherwise(F.col("lang")).alias("lang"), "n")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def vector_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector.vector_top(_vector_queries(spark, sf_dir), vectors, 25).where("score > 0").select("query_id", "rank", "vec_id", "score")


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two ranked lists of each question: BM25, and the longest documents that hold one of its terms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scores = bm25.bm25_global(docs, _queries(spark)).withColumn("score", rounded(F.col("score"), 6))
    lexical = bm25.top_n(scores, fusion.POOL, ["query_id"]).select("query_id", "doc_id", "rank")
    by_length = scores.where("score > 0").join(docs.select("doc_id", F.col("n_chars").cast("double").alias("length")), "doc_id").select("query_id", "doc_id", F.col("length").alias("score"))
    return lexical, bm25.top_n(by_length, fusion.POOL, ["query_id"]).select("query_id", "doc_id", "rank")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(*_lists(spark, sf_dir))
    return fused.select("query_id", "doc_id", "fused_rank", rounded(F.col("fused_score"), 8).alias("fused_score"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused pool, reranked by a stand-in score: shorter documents first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    pool = fusion.reciprocal_rank_fusion(*_lists(spark, sf_dir)).join(docs, "doc_id")
    pool = pool.withColumn("ce_score", -F.col("n_chars").cast("double")).withColumn("contains_table", F.col("text").contains("$"))
    return fusion.combine(pool.withColumn("rescuable", fusion.is_rescuable(F.col("text"), F.col("contains_table"))))


def fused_floor_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("query_id", "doc_id", "fused_rank", "ce_rank", "combined_rank", rounded(F.col("combined_score"), 8).alias("combined_score"))


def table_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rescue(_ranked(spark, sf_dir))


def maxp_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best window of every document of each question's pool, by shared tokens."""
    docs = _documents(spark, sf_dir)
    pool = bm25.top_n(bm25.bm25_global(docs, _queries(spark)).withColumn("score", rounded(F.col("score"), 6)), fusion.POOL, ["query_id"]).select("query_id", "doc_id")
    texts = docs.join(F.broadcast(pool), "doc_id").join(F.broadcast(_queries(spark)), "query_id")  # POOL rows for each of a stated list of questions
    pairs = lexical_scorer(texts.select("query_id", "query", "doc_id", F.explode(windows.windows_of(F.col("text"))).alias("window")))
    return fusion.max_per_owner(pairs).select("query_id", "doc_id", rounded(F.col("score"), 6).alias("score"))


def hybrid_search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search of the same questions, reranked by their best windows."""
    chunks, queries, calendars = _searches(spark, sf_dir)
    found = hybrid_search(chunks.withColumn("contains_table", F.col("text").contains("$")), queries, calendars)
    return found.select("query_id", "doc_id", "final_rank", "fused_rank", "ce_rank", rounded(F.col("combined_score"), 8).alias("combined_score"), "rescued", "label")


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: a nation's order days, urgent orders being annual reports."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("report_date"), "o_orderpriority", F.col("o_orderkey").alias("pos"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("ticker"))
    return scope.filing_list(orders.join(customers, "c_custkey").withColumn("form", F.when(F.col("o_orderpriority").startswith("1"), "10-K").otherwise("10-Q")))


def period_scope_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.sql("SELECT * FROM VALUES (1, '3', DATE'1996-12-28'), (2, NULL, DATE'1997-07-04'), (3, '7', DATE'2000-02-29') AS t(query_id, ticker, target)")
    return scope.near_dates(named, _filings(spark, sf_dir)).select("query_id", "filing_ticker", "form", "report_date", "first_seen")


def _calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("ticker"), (F.col("n_nationkey") % 12 + 1).alias("end_month"))


def fiscal_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql("SELECT * FROM VALUES (1, '3', 1997, CAST(NULL AS INT)), (2, NULL, 1998, 2), (3, '7', 2000, 4) AS t(query_id, ticker, fy, quarter)")
    return scope.fiscal_matches(asked, _filings(spark, sf_dir), _calendars(spark, sf_dir)).select("query_id", "filing_ticker", "form", "report_date", "fy", "fq")


def period_scope_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of questions in words, against all filings."""
    asked = spark.createDataFrame([
        ("a", "3", "Revenue as of December 28, 1996?"), ("b", "3", "margin in fiscal year 1997"), ("c", "7", "inventory in the second quarter of FY98"),
        ("d", None, "What happened on February 30, 1997?"), ("e", "3", "no period at all"), ("f", "3", "cash at March 1, 2031 or FY1999"), ("g", "5", "Q4 fiscal 2000 sales"),
    ], "query_id string, ticker string, query string")
    return scope.query_scopes(asked, _filings(spark, sf_dir), _calendars(spark, sf_dir)).select("query_id", F.array_join(F.transform("report_dates", lambda d: d.cast("string")), ",").alias("report_dates"), "reason", "n_invalid")


#: Searches as (query_id, ticker, query, vec_id of the query's vector).
SEARCHES = (
    ("own_date", "en", "license terms as of March 31, 1997", 1), ("own_year", "en", "password and token in fiscal year 1997", 2), ("any_quarter", None, "the license in the second quarter of fiscal year 2096", 3),
    ("no_match", "fr", "license in fiscal year 2031", 4), ("whole", None, "Apache License version", 5), ("own", "de", "secret token of the license", 6),
)


def _searches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, queries, calendars): documents as chunks; languages are tickers, ids give form and report date."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = _documents(spark, sf_dir).join(vectors, "doc_id", "left")
    date = F.last_day(F.add_months(F.lit("1996-03-01").cast("date"), (F.col("doc_id") % 8 * 3).cast("int")))
    chunks = docs.select("doc_id", F.col("lang").alias("ticker"), F.when(F.col("doc_id") % 4 == 0, "10-K").otherwise("10-Q").alias("form"), date.alias("report_date"), "text", "embedding")
    asked = spark.createDataFrame(list(SEARCHES), "query_id string, ticker string, query string, doc_id long")
    queries = asked.join(vectors.withColumnRenamed("embedding", "q"), "doc_id").drop("doc_id")
    return chunks, queries, spark.createDataFrame([("en", 12), ("de", 9), ("fr", 6), ("es", 3)], "ticker string, end_month int")


def hybrid_search_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped and filtered search over documents as chunks."""
    return fused_pool(*_searches(spark, sf_dir)).withColumn("fused_score", rounded(F.col("fused_score"), 8))


QUERIES = {f.__name__: f for f in (hybrid_search_pool, hybrid_search_top, bm25_topk_by_partition, bm25_topk_global_okapi, bm25_term_statistics, vector_topk_exact, rrf_fusion, fused_floor_rerank, table_rescue, maxp_windows, period_scope_range_join, fiscal_label_join, period_scope_questions)}

_Q = "questions(query_id, query) AS (VALUES " + ", ".join(f"('{i}', '{q}')" for i, q in QUESTIONS) + ")"
_BASE = f"""{_Q},
docs AS (SELECT doc_id, lang, n_chars, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS toks FROM documents),
terms AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM questions) GROUP BY 1, 2),
post AS (SELECT doc_id, lang, len(toks) AS dl, term, count(*) AS tf FROM (SELECT doc_id, lang, toks, unnest(toks) AS term FROM docs) WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, lang, len(toks), term)"""
_OKAPI = f"""{_BASE},
g AS (SELECT count(*) AS big_n, avg(len(toks)) AS avgdl FROM docs),
vocab AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(toks)) AS term FROM docs) GROUP BY 1),
raws AS (SELECT term, ln((big_n - n + 0.5) / (n + 0.5)) AS raw FROM vocab, g),
idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raws) ELSE raw END AS idf FROM raws),
scores AS (SELECT query_id, doc_id, floor(sum(weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * 1e6 + 0.5) / 1e6 AS score FROM post JOIN terms USING (term) JOIN idf USING (term), g GROUP BY 1, 2)"""
_LISTS = f"""{_OKAPI},
l0 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0 QUALIFY rank <= 25),
l1 AS (SELECT query_id, s.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, s.doc_id) AS rank FROM scores s JOIN docs USING (doc_id) WHERE score > 0 AND n_chars > 0 QUALIFY rank <= 25),
fused AS (SELECT query_id, doc_id, coalesce(1.0::DOUBLE / (60 + l0.rank), 0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + l1.rank), 0::DOUBLE) AS fused_score, CASE WHEN l0.rank IS NULL THEN 1 ELSE 0 END AS no, coalesce(l0.rank, l1.rank) AS first FROM l0 FULL JOIN l1 USING (query_id, doc_id)),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, no, first)::INTEGER AS fused_rank FROM fused)"""
_RANKED = f"""{_LISTS},
ce AS (SELECT p.*, text, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, fused_rank)::INTEGER AS ce_rank FROM pool p JOIN docs USING (doc_id)),
comb AS (SELECT *, CASE WHEN fused_rank > 3 THEN 1.0::DOUBLE / (60 + ce_rank) ELSE greatest(1.0::DOUBLE / (60 + fused_rank), 1.0::DOUBLE / (60 + ce_rank)) + 1e-9::DOUBLE * (1.0::DOUBLE / (60 + ce_rank)) END AS cs FROM ce),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cs DESC, fused_rank)::INTEGER AS combined_rank, contains(text, '$') AS has_table, length(text) - length(replace(text, '$', '')) >= 5 AS rescuable FROM comb)"""
_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_FILINGS = """filings AS (SELECT c_nationkey::VARCHAR AS ticker, CASE WHEN o_orderpriority LIKE '1%' THEN '10-K' ELSE '10-Q' END AS form, o_orderdate::DATE AS report_date, min(o_orderkey) AS first_seen FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
labelled AS (SELECT f.*, (year(report_date) + CASE WHEN month(report_date) > n_nationkey % 12 + 1 THEN 1 ELSE 0 END)::INTEGER AS fy, ((month(report_date) - (n_nationkey % 12 + 1) - 1 + 24) % 12 // 3 + 1)::INTEGER AS fq FROM filings f JOIN nation ON n_nationkey::VARCHAR = ticker)"""

_SEARCHES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in SEARCHES)

_SEARCH_SQL = f"""WITH asked(query_id, ticker, query, vec) AS (VALUES {_SEARCHES}), calendars(ticker, m) AS (VALUES ('en', 12), ('de', 9), ('fr', 6), ('es', 3)),
c AS (SELECT doc_id, lang AS ticker, doc_id % 4 = 0 AS annual, last_day(DATE '1996-03-01' + to_months((3 * (doc_id % 8))::INTEGER)) AS d, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS toks, embedding::DOUBLE[] AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
f AS (SELECT DISTINCT ticker, annual, d, year(d) + (month(d) > m)::INTEGER AS fy, (month(d) - m - 1 + 24) % 12 // 3 + 1 AS fq FROM c JOIN calendars USING (ticker)),
dates AS (SELECT DISTINCT 'own_date' AS query_id, d FROM f WHERE ticker = 'en' AND abs(date_diff('day', DATE '1997-03-31', d)) <= 7 UNION SELECT 'own_year', d FROM f WHERE ticker = 'en' AND annual AND fy = 1997
  UNION SELECT 'any_quarter', d FROM f WHERE fy = 2096 AND fq = 2 UNION SELECT 'no_match', d FROM f WHERE ticker = 'fr' AND annual AND fy = 2031),
reasons AS (SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM dates) THEN 'dates' WHEN query_id IN ('whole', 'own') THEN 'no_date' ELSE 'no_match' END AS reason FROM asked),
u AS (SELECT a.query_id, vec, c.* FROM asked a JOIN c ON a.ticker IS NULL OR a.ticker = c.ticker),
g AS (SELECT query_id, count(*) AS big_n, avg(len(toks)) AS avgdl FROM u GROUP BY 1),
vocab AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest(list_distinct(toks)) AS term FROM u) GROUP BY 1, 2),
raws AS (SELECT query_id, term, ln((big_n - n + 0.5) / (n + 0.5)) AS raw FROM vocab JOIN g USING (query_id)),
idf AS (SELECT query_id, term, CASE WHEN raw < 0 THEN avg(raw) OVER (PARTITION BY query_id) * 0.25 ELSE raw END AS idf FROM raws),
terms AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM asked) GROUP BY 1, 2),
post AS (SELECT query_id, doc_id, dl, term, count(*) AS tf FROM (SELECT query_id, doc_id, len(toks) AS dl, unnest(toks) AS term FROM u) WHERE (query_id, term) IN (SELECT (query_id, term) FROM terms) GROUP BY ALL),
lex AS (SELECT query_id, doc_id, floor(sum(weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * 1e6 + 0.5) / 1e6 AS score FROM post JOIN terms USING (query_id, term) JOIN idf USING (query_id, term) JOIN g USING (query_id) GROUP BY 1, 2),
den AS (SELECT query_id, doc_id, floor(list_dot_product(q.v, u.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(u.v, u.v))) * 1e6 + 0.5) / 1e6 AS score FROM u JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) q ON q.vec_id = vec WHERE u.v IS NOT NULL),
cand AS (SELECT s.*, reason, EXISTS (SELECT 1 FROM dates t WHERE t.query_id = s.query_id AND t.d = c.d) AS ins FROM (SELECT 0 AS r, * FROM lex WHERE score > 0 UNION ALL SELECT 1, * FROM den) s JOIN c USING (doc_id) JOIN reasons USING (query_id)),
lab AS (SELECT *, CASE WHEN reason <> 'dates' THEN reason WHEN bool_or(ins) OVER (PARTITION BY query_id) THEN 'dates' ELSE 'filtered_empty' END AS label FROM cand),
lists AS (SELECT *, row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, doc_id) AS rank FROM lab WHERE label <> 'dates' OR ins QUALIFY rank <= 25),
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.label, b.label) AS label, coalesce(1.0::DOUBLE / (60 + a.rank), 0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + b.rank), 0::DOUBLE) AS s, CASE WHEN a.rank IS NULL THEN 1 ELSE 0 END AS no, coalesce(a.rank, b.rank) AS first
  FROM (SELECT * FROM lists WHERE r = 0) a FULL JOIN (SELECT * FROM lists WHERE r = 1) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
pool AS (SELECT query_id, doc_id, s, label, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, no, first)::INTEGER AS fused_rank FROM fused)"""
#: Best window of each row of ``pool`` for the question in ``asked``: lines gathered up to 380 words, one more counted for each line.
_MAXP = r"""lined AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IN (SELECT doc_id FROM pool)),
dealt AS (SELECT doc_id, ls, list_reduce(list_transform(ls, lambda l, i: {'w': 0, 'c': len(regexp_extract_all(l, '\S+')) + 1, 'a': CASE WHEN i = 1 THEN [0] ELSE []::INTEGER[] END}),
  lambda s, x: CASE WHEN s.c + x.c > 380 THEN {'w': s.w + 1, 'c': x.c, 'a': list_append(s.a, s.w + 1)} ELSE {'w': s.w, 'c': s.c + x.c, 'a': list_append(s.a, s.w)} END).a AS ws FROM lined),
held AS (SELECT DISTINCT doc_id, w, unnest(regexp_extract_all(lower(l), '[a-z0-9]+')) AS term FROM (SELECT doc_id, unnest(ws) AS w, unnest(ls) AS l FROM dealt)),
sought AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM asked),
maxp AS (SELECT query_id, doc_id, max(n)::DOUBLE / any_value(big) AS score FROM (
  SELECT p.query_id, p.doc_id, w, count(h.term) AS n, any_value(t.big) AS big FROM pool p JOIN (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS big FROM sought) t USING (query_id) LEFT JOIN held h ON h.doc_id = p.doc_id AND h.term = t.term GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

ORACLES = {
    "hybrid_search_pool": f"{_SEARCH_SQL} SELECT query_id, doc_id, fused_rank, floor(s * 1e8 + 0.5) / 1e8 AS fused_score, label FROM pool",
    "maxp_windows": f"""WITH {_OKAPI}, pool AS (SELECT query_id, doc_id FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 25),
asked AS (SELECT query_id, query FROM questions), {_MAXP} SELECT query_id, doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM maxp""",
    "hybrid_search_top": f"""{_SEARCH_SQL}, {_MAXP},
ce AS (SELECT p.*, contains(text, '$') AS tab, contains(text, '$') AND length(text) - length(replace(text, '$', '')) >= 5 AS able, row_number() OVER (PARTITION BY p.query_id ORDER BY m.score DESC, fused_rank) AS ce_rank, count(*) OVER (PARTITION BY p.query_id) // 2 AS half
  FROM pool p JOIN maxp m USING (query_id, doc_id) JOIN documents USING (doc_id)),
sums AS (SELECT *, CASE WHEN fused_rank > 3 THEN 1.0::DOUBLE / (60 + ce_rank) ELSE greatest(1.0::DOUBLE / (60 + fused_rank), 1.0::DOUBLE / (60 + ce_rank)) + 1e-9::DOUBLE * (1.0::DOUBLE / (60 + ce_rank)) END AS combined FROM ce),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, fused_rank) AS combined_rank FROM sums),
tops AS (SELECT *, bool_or(combined_rank <= 5 AND tab) OVER (PARTITION BY query_id) AS has FROM ranks),
swaps AS (SELECT *, min(fused_rank) FILTER (NOT has AND able AND fused_rank <= half AND combined_rank > 5) OVER (PARTITION BY query_id) AS swap FROM tops)
SELECT query_id, doc_id, CASE WHEN fused_rank = swap THEN 5 ELSE combined_rank END::INTEGER AS final_rank, fused_rank, ce_rank::INTEGER AS ce_rank, floor(combined * 1e8 + 0.5) / 1e8 AS combined_score, coalesce(fused_rank = swap, false) AS rescued, label
FROM swaps WHERE coalesce(fused_rank = swap, false) OR (combined_rank <= 5 AND (swap IS NULL OR combined_rank < 5))""",
    "bm25_topk_by_partition": f"""WITH {_BASE}, g AS (SELECT lang, count(*) AS big_n, avg(len(toks)) AS avgdl FROM docs GROUP BY 1), df AS (SELECT lang, term, count(*) AS n FROM post GROUP BY 1, 2),
scores AS (SELECT query_id, lang, doc_id, floor(sum(weight * ln(1 + (big_n - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * 1e6 + 0.5) / 1e6 AS score FROM post JOIN terms USING (term) JOIN df USING (lang, term) JOIN g USING (lang) GROUP BY 1, 2, 3)
SELECT query_id, lang, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10""",
    "bm25_topk_global_okapi": f"WITH {_OKAPI} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 25",
    "bm25_term_statistics": f"""WITH {_BASE}, t AS (SELECT lang, unnest(list_distinct(toks)) AS term FROM docs)
SELECT term, CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, count(*) AS n FROM t GROUP BY GROUPING SETS ((term, lang), (term))""",
    "vector_topk_exact": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, floor({_COS} * 1e6 + 0.5) / 1e6 AS score FROM v a, v b WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 25""",
    "rrf_fusion": f"WITH {_LISTS} SELECT query_id, doc_id, fused_rank, floor(fused_score * 1e8 + 0.5) / 1e8 AS fused_score FROM pool",
    "fused_floor_rerank": f"WITH {_RANKED} SELECT query_id, doc_id, fused_rank, ce_rank, combined_rank, floor(cs * 1e8 + 0.5) / 1e8 AS combined_score FROM ranked",
    "table_rescue": f"""WITH {_RANKED}, m AS (SELECT *, bool_or(combined_rank <= 5 AND has_table) OVER (PARTITION BY query_id) AS has, count(*) OVER (PARTITION BY query_id) // 2 AS half FROM ranked),
s AS (SELECT *, min(CASE WHEN NOT has AND rescuable AND fused_rank <= half AND combined_rank > 5 THEN fused_rank END) OVER (PARTITION BY query_id) AS swap FROM m)
SELECT query_id, doc_id, CASE WHEN coalesce(fused_rank = swap, false) THEN 5 ELSE combined_rank END::INTEGER AS final_rank, coalesce(fused_rank = swap, false) AS rescued FROM s
WHERE coalesce(fused_rank = swap, false) OR (combined_rank <= 5 AND (swap IS NULL OR combined_rank < 5))""",
    "period_scope_range_join": f"""WITH {_FILINGS}, named(query_id, ticker, target) AS (VALUES (1, '3', DATE '1996-12-28'), (2, NULL, DATE '1997-07-04'), (3, '7', DATE '2000-02-29'))
SELECT query_id, f.ticker AS filing_ticker, form, report_date, first_seen FROM named n JOIN filings f ON abs(date_diff('day', target, report_date)) <= 7 AND (n.ticker IS NULL OR n.ticker = f.ticker)""",
    "fiscal_label_join": f"""WITH {_FILINGS}, asked(query_id, ticker, fy, quarter) AS (VALUES (1, '3', 1997, NULL), (2, NULL, 1998, 2), (3, '7', 2000, 4))
SELECT query_id, l.ticker AS filing_ticker, form, report_date, l.fy, fq FROM asked a JOIN labelled l ON a.fy = l.fy AND (a.ticker IS NULL OR a.ticker = l.ticker) AND CASE WHEN quarter IS NULL THEN form = '10-K' ELSE fq = quarter END""",
    "period_scope_questions": f"""WITH {_FILINGS}, a AS (SELECT report_date AS d FROM filings WHERE ticker = '3' AND abs(date_diff('day', DATE '1996-12-28', report_date)) <= 7),
p(query_id, ticker, fy, quarter) AS (VALUES ('b', '3', 1997, NULL), ('c', '7', 2098, 2), ('f', '3', 1999, NULL), ('g', '5', 2000, 4)),
m AS (SELECT query_id, report_date AS d FROM p JOIN labelled l ON p.fy = l.fy AND p.ticker = l.ticker AND CASE WHEN quarter IS NULL THEN form = '10-K' ELSE fq = quarter END UNION ALL SELECT 'a', d FROM a),
q(query_id, otherwise, n_invalid) AS (VALUES ('a', 'no_match', 0), ('b', 'no_match', 0), ('c', 'no_match', 0), ('d', 'no_date', 1), ('e', 'no_date', 0), ('f', 'no_match', 0), ('g', 'no_match', 0))
SELECT query_id, coalesce((SELECT string_agg(d::VARCHAR, ',' ORDER BY d) FROM (SELECT DISTINCT d FROM m WHERE m.query_id = q.query_id)), '') AS report_dates,
  CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.query_id = q.query_id) THEN 'dates' ELSE otherwise END AS reason, n_invalid FROM q""",
}
