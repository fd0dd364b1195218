"""Corpus, gold and verification operators on documents, pages, benchmark, conversations and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fiscal, numbers, text
from factloom.functions.numeric import fixed_point, printed_figure_match, rounded
from factloom.operators import bm25, chunking, corpus, goldrank, verification
from factloom.plans.derivation import compile_tree
from factloom.plans.derivation import corner_spread as corners
from factloom.plans.retrieval_queries import _OKAPI, _queries
from factloom.sources.tables import table
from factloom.streaming.limiter import limit_batch


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files before and after a change: one source is new, one is gone, one language was edited."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("relpath"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("accession"), "lang")
    before = docs.where("accession <> 'src3'")
    after = docs.where("accession <> 'src5'").withColumn("content", F.when(F.col("lang") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return corpus.manifest(before), corpus.manifest(after)


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.manifest_diff(*_files(spark, sf_dir))


def corpus_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("relpath"), F.coalesce("text", F.lit("")).alias("content"), "source")
    return corpus.corpus_identity(docs.select("ord", "relpath", F.sha2(F.col("content").cast("binary"), 256).alias("sha")))


def absence_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("Apache License",), ("general public license",), ("no such words here",), ("All rights reserved.",), ("the and",)], "term string")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("part"), plain(F.coalesce("text", F.lit(""))).alias("folded"))
    return corpus.absence(docs, terms.withColumn("folded", plain(F.col("term")))).drop("snippet")


def gold_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents, with what stands around them."""
    return _found(spark, sf_dir)


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_ids(table(spark, sf_dir, "lineitem").select(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id")))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("anchor"))
    return corpus.containment(gold, table(spark, sf_dir, "documents").select("doc_id", "text"))


def gold_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).drop("snippet")


def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of two items each; a language is a query, and hits an item if one of its documents holds it."""
    langs = _found(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("item_id", F.col("lang").alias("query_id"), F.lit(True).alias("hit")).distinct()
    items = table(spark, sf_dir, "benchmark").select("item_id", F.floor(F.col("item_id") / 2).alias("qid"))
    return goldrank.coverage(items.join(langs, "item_id", "left").withColumnRenamed("item_id", "part"))


def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("ticker"), F.col("source").alias("filing"))
    scores = bm25.bm25_global(docs, _queries(spark)).withColumn("score", rounded(F.col("score"), 6))
    return goldrank.rank_stats(scores.where("score > 0").join(docs.select("doc_id", "ticker", "filing"), "doc_id"))


def gold_rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order(spark, sf_dir).select("query_id", "doc_id", "rank", "own_filing_rank", "other_filing_ahead", "other_ticker_ahead")


def gold_ranks_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the documents that hold a benchmark passage stand in each question's lexical order, counted without sorting it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("ticker"), F.col("source").alias("filing"))
    scores = bm25.bm25_global(docs, _queries(spark)).withColumn("score", rounded(F.col("score"), 6)).where("score > 0").join(docs.drop("text"), "doc_id")
    gold = _found(spark, sf_dir).select("doc_id").distinct().crossJoin(F.broadcast(_queries(spark).select("query_id")))  # a stated list of questions
    return goldrank.gold_ranks(scores, gold).select("query_id", "doc_id", "rank", "own_filing_rank", "other_filing_ahead", "other_ticker_ahead")


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as logged searches: the first words are the query, conversations are runs; every fifth has no question, odd questions no gold."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("ord"), F.substring_index("text", " ", 1).alias("query"), F.when(F.col("turn") % 4 > 0, (F.col("turn") % 4).cast("string")).alias("ticker"))
    return goldrank.query_set(turns, *_asked_questions(turns)).select("query", "ticker", F.array_join("qids", ",").alias("qids"), "first_seen")


def _asked_questions(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = turns.select("run_id").distinct().withColumn("qid", F.when(F.col("run_id") % 5 == 0, "?").otherwise((F.col("run_id") % 30).cast("string"))).where("run_id % 11 <> 0")
    return ids, ids.where("qid <> '?'").select("qid").distinct().where("cast(qid as int) % 2 = 0")


def query_set_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the same searches are left out, and why."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("run_id"))
    return goldrank.query_set_drops(turns, *_asked_questions(turns))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ranked document as a gold row: lexical rank struct from BM25, the other by document length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("lang").alias("ticker"), F.col("source").alias("filing"))
    lexical = _order(spark, sf_dir)
    stats = ("rank", "own_filing_rank", "other_filing_ahead", "other_ticker_ahead")
    by_length = goldrank.rank_stats(lexical.select("query_id", "doc_id", "ticker", "filing").join(docs.select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id"))
    joined = lexical.select("query_id", "doc_id", "ticker", F.struct(*stats).alias("bm25")).join(by_length.select("query_id", "doc_id", F.struct(*stats).alias("vector")), ["query_id", "doc_id"])
    final = F.when(F.col("bm25.rank") + F.col("vector.rank") <= 12, F.col("bm25.rank"))
    pool = F.when(F.least("bm25.rank", "vector.rank") <= 8, F.least("bm25.rank", "vector.rank"))
    return joined.withColumns({"final_rank": final, "pool_pos": pool, "scope_excluded": F.col("ticker") == "fr"})


def miss_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("query_id", "doc_id", goldrank.miss_class().alias("class"))


def best_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goldrank.best_gold(_records(spark, sf_dir).withColumn("part", F.col("ticker"))).select("query_id", "part", "doc_id")


def gold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("class", goldrank.miss_class()).select("class", (F.col("doc_id") % 2 == 0).alias("own_period"), (F.col("class") == "hit").alias("hit"))
    return goldrank.summary(rows).withColumn("hit_rate", rounded(F.col("hit_rate"), 6))


def number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of all documents."""
    docs = table(spark, sf_dir, "documents").where("text rlike '[0-9]'").select("doc_id", F.explode(numbers.numbers_in(F.col("text"))).alias("n"))
    return docs.select("doc_id", "n.value", "n.unit", "n.start", "n.end", "n.paren")


def number_tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit runs of the documents within one percent of a part's price in cents; an equi-join on logarithmic buckets."""
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).alias("d")).where("length(d) between 4 and 9")
    found = runs.select("doc_id", F.col("d").cast("double").alias("found")).withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.log("found") / 0.02) + i)))
    prices = table(spark, sf_dir, "part").select(F.floor(F.col("p_retailprice") * 100 + 0.5).cast("double").alias("expected")).distinct().withColumn("_b", F.floor(F.log("expected") / 0.02))
    near = found.join(prices, "_b").where(F.abs(F.col("found") - F.col("expected")) <= F.greatest(F.abs("expected") * 0.01, F.lit(0.05)))
    return near.groupBy("doc_id", "found").agg(F.count("*").alias("n"), F.min("expected").alias("least"), F.max("expected").alias("most"))


def html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = chunking.parse_filings(table(spark, sf_dir, "pages").select("page_id", "html"))
    return parsed.select("page_id", F.length("text").alias("n_chars"), F.size("tables").alias("n_tables"), F.sha2("document", 256).alias("sha"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return out.select("doc_id", "chunk_index", "char_length", "contains_table", F.sha2("text", 256).alias("sha"))


def derivation_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(price x quantity less discount) as a percentage of the price paid, as one compiled tree."""
    tree = {"operation": "percent_change", "a": {"operation": "multiply", "a": {"column": "l_extendedprice"}, "b": {"operation": "subtract", "a": 1, "b": {"column": "l_discount"}}}, "b": {"column": "l_extendedprice"}}
    rows = table(spark, sf_dir, "lineitem").withColumn("pct", rounded(compile_tree(tree), 2))
    return rows.groupBy("l_returnflag", "pct").agg(F.count("*").alias("n"))


def corner_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"operation": "divide", "a": {"column": "p_retailprice"}, "b": {"column": "p_size"}}
    out = corners(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), tree, {"p_retailprice": 0.05, "p_size": 0.5})
    return out.select("p_partkey", rounded(F.col("low"), 6).alias("low"), rounded(F.col("high"), 6).alias("high"))


def printed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose price prints as a part's price in tens, by part price."""
    prices = table(spark, sf_dir, "part").select(F.floor(F.col("p_retailprice") / 10 + 0.5).alias("p")).distinct()
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", F.floor(F.col("l_extendedprice") / 10 + 0.5).alias("p"))
    near = lines.join(prices, "p").where(printed_figure_match(F.col("l_extendedprice"), F.col("p") * 10.0, F.lit(-1)))
    return near.groupBy("p").agg(F.count("*").alias("n"))


def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(fixed_point(F.col("l_extendedprice") * 100).alias("printed")).agg(F.count("*").alias("n"))


def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"), F.when(F.col("o_orderpriority").startswith("1"), "10-K").otherwise("10-Q").alias("form"))
    return orders.groupBy(fiscal.period_label(F.col("d"), F.lit(9), F.col("form")).alias("label")).agg(F.count("*").alias("n"))


def rate_limiter_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three events of a user in a day that starts with the first allowed one."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("ord"))
    return limit_batch(events, 3, 86400.0)


def text_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalised_text(F.col("text")).alias("t"))
    return out.select("conv_id", "turn", F.length("t").alias("n"), F.sha2("t", 256).alias("sha"))


def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn claims the turn before it, quoting its own first sentence; every user turn quotes its own text."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("idx"), "role", "text")
    results = turns.select("answer_id", (F.col("idx") + 1).cast("int").alias("idx"), "text", F.lit(None).cast("string").alias("header"))
    own = F.when(F.col("role") == "assistant", F.col("idx")).otherwise(F.col("idx") + 1).cast("int")
    claims = turns.select("answer_id", F.col("idx").alias("claim_no"), own.alias("citation_index"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.substring_index("text", ".", 1).alias("quote"))
    out = verification.claim_verdicts(claims, results)
    return out.groupBy(F.coalesce("check", F.lit("grounded")).alias("check")).agg(F.count("*").alias("n"))


def coverage_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents that the claims of their source, one number each, leave uncovered."""
    docs = table(spark, sf_dir, "documents").where("text rlike '[0-9]{2}'")
    answers = docs.select(F.col("doc_id").alias("answer_id"), F.lit("What are the 42 numbers?").alias("question"), F.col("text").alias("answer_text"))
    claims = docs.select(F.col("doc_id").alias("answer_id"), F.regexp_extract("text", "[0-9]{2,9}", 0).cast("double").alias("value"), F.lit("raw").alias("unit"))
    results = answers.select("answer_id", F.lit("none").alias("chunk_index"), F.lit("").alias("text"))
    return verification.uncovered_numbers(answers, claims, results)


QUERIES = {
    f.__name__: f
    for f in (
        manifest_diff, corpus_identity, absence_terms, duplicate_ids, gold_containment_join, gold_snippets, gold_coverage, gold_rank_stats, gold_ranks_by_count, query_set, query_set_drops, miss_class, best_gold, gold_summary, number_extract, number_tolerance_join,
        html_parse, chunk_documents, derivation_eval, corner_spread, printed_figures, number_format, period_labels, rate_limiter_fixed_window, text_normalisation, claim_grounding, coverage_uncovered,
    )
}

_FLAT = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))"
_STATS = """s0 AS (SELECT query_id, s.doc_id, score, lang AS ticker, source AS filing, n_chars FROM scores s JOIN documents USING (doc_id) WHERE score > 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, row_number() OVER (PARTITION BY query_id, ticker, filing ORDER BY score DESC, doc_id)::INTEGER AS own_filing_rank, row_number() OVER (PARTITION BY query_id, ticker ORDER BY score DESC, doc_id)::INTEGER AS tr FROM s0),
len AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id)::INTEGER AS lrank, row_number() OVER (PARTITION BY query_id, ticker, filing ORDER BY n_chars DESC, doc_id)::INTEGER AS lown, row_number() OVER (PARTITION BY query_id, ticker ORDER BY n_chars DESC, doc_id)::INTEGER AS ltr FROM s0),
rec AS (SELECT *, CASE WHEN rank + lrank <= 12 THEN rank END AS final_rank, CASE WHEN least(rank, lrank) <= 8 THEN least(rank, lrank) END AS pool_pos, ticker = 'fr' AS scope_excluded, rank <= lrank AS lex FROM ord JOIN len USING (query_id, doc_id)),
cls AS (SELECT *, CASE WHEN final_rank IS NOT NULL THEN 'hit' WHEN pool_pos IS NOT NULL THEN 'rerank' WHEN scope_excluded THEN 'scope_excluded' WHEN lrank <= 25 THEN 'index_recall' WHEN (CASE WHEN lex THEN own_filing_rank ELSE lown END) > 10 THEN 'dilution'
  WHEN (CASE WHEN lex THEN tr - own_filing_rank ELSE ltr - lown END) >= greatest(CASE WHEN lex THEN rank - tr ELSE lrank - ltr END, 1) THEN 'period_confusion' ELSE 'other_ticker' END AS class FROM rec)"""

ORACLES = {
    "manifest_diff": """WITH p AS (SELECT doc_id::VARCHAR AS relpath, coalesce(text, '') AS c FROM documents WHERE source <> 'src3'), n AS (SELECT doc_id::VARCHAR AS relpath, coalesce(text, '') || CASE WHEN lang = 'fr' THEN '!' ELSE '' END AS c FROM documents WHERE source <> 'src5')
SELECT relpath, CASE WHEN p.c IS NULL THEN 'add' WHEN n.c IS NULL THEN 'delete' WHEN sha256(p.c) <> sha256(n.c) THEN 'replace' ELSE 'unchanged' END AS action FROM p FULL JOIN n USING (relpath)""",
    "corpus_identity": """WITH leaf AS (SELECT doc_id AS ord, sha256(doc_id::VARCHAR || chr(0) || sha256(coalesce(text, ''))) AS d FROM documents),
a AS (SELECT ord // 1000 AS ord, count(*) AS n, sha256(string_agg(d, '' ORDER BY ord)) AS d FROM leaf GROUP BY 1),
b AS (SELECT ord // 1000 AS ord, sum(n) AS n, sha256(string_agg(d, '' ORDER BY ord)) AS d FROM a GROUP BY 1), c AS (SELECT ord // 1000 AS ord, sum(n) AS n, sha256(string_agg(d, '' ORDER BY ord)) AS d FROM b GROUP BY 1)
SELECT sum(n)::BIGINT AS files, substr(sha256(string_agg(d, '' ORDER BY ord)), 1, 12) AS sha FROM c""",
    "absence_terms": """WITH t(term) AS (VALUES ('Apache License'), ('general public license'), ('no such words here'), ('All rights reserved.'), ('the and')), f AS (SELECT term, ' ' || trim(regexp_replace(lower(term), '[^0-9a-z]+', ' ', 'g')) || ' ' AS needle FROM t),
d AS (SELECT doc_id, lang AS part, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-z]+', ' ', 'g')) || ' ' AS folded FROM documents)
SELECT part, term, count(*) FILTER (contains(folded, needle)) AS n, min(doc_id) FILTER (contains(folded, needle)) AS first_doc FROM d, f GROUP BY 1, 2""",
    "duplicate_ids": "SELECT l_orderkey || '_' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "gold_containment_join": f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({_FLAT.format('d.text')}, {_FLAT.format('b.text')})",
    "gold_snippets": f"""WITH f AS (SELECT item_id, doc_id, {_FLAT.format('d.text')} AS t, {_FLAT.format('b.text')} AS n FROM benchmark b JOIN documents d ON contains({_FLAT.format('d.text')}, {_FLAT.format('b.text')}))
SELECT item_id, doc_id, substr(t, greatest(strpos(t, n) - 60, 1), strpos(t, n) - greatest(strpos(t, n) - 60, 1) + length(n) + 60) AS snippet FROM f""",
    "gold_ranks_by_count": f"""WITH {_OKAPI}, {_STATS}, f AS (SELECT DISTINCT doc_id FROM benchmark b JOIN documents d ON contains({_FLAT.format('d.text')}, {_FLAT.format('b.text')}))
SELECT query_id, doc_id, rank, own_filing_rank, tr - own_filing_rank AS other_filing_ahead, rank - tr AS other_ticker_ahead FROM ord JOIN f USING (doc_id)""",
    "query_set": """WITH t AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS query, CASE WHEN turn % 4 > 0 THEN (turn % 4)::VARCHAR END AS ticker, (conv_id % 30)::VARCHAR AS qid FROM conversations WHERE role = 'user' AND conv_id % 5 <> 0 AND conv_id % 11 <> 0 AND conv_id % 30 % 2 = 0)
SELECT query, ticker, array_to_string(list_sort(list_distinct(list(qid))), ',') AS qids, min(turn) AS first_seen FROM t GROUP BY query, ticker""",
    "query_set_drops": "SELECT count(*) FILTER (conv_id % 5 = 0 OR conv_id % 11 = 0) AS unjoined, count(*) FILTER (conv_id % 5 <> 0 AND conv_id % 11 <> 0 AND conv_id % 30 % 2 = 1) AS no_gold FROM conversations WHERE role = 'user'",
    "gold_coverage": f"""WITH f AS (SELECT DISTINCT item_id FROM benchmark b JOIN documents d ON contains({_FLAT.format('d.text')}, {_FLAT.format('b.text')}))
SELECT item_id // 2 AS qid, bool_and(f.item_id IS NOT NULL) AS covered FROM benchmark b LEFT JOIN f USING (item_id) GROUP BY 1""",
    "gold_rank_stats": f"WITH {_OKAPI}, {_STATS} SELECT query_id, doc_id, rank, own_filing_rank, tr - own_filing_rank AS other_filing_ahead, rank - tr AS other_ticker_ahead FROM ord",
    "miss_class": f"WITH {_OKAPI}, {_STATS} SELECT query_id, doc_id, class FROM cls",
    "best_gold": f"WITH {_OKAPI}, {_STATS} SELECT query_id, ticker AS part, doc_id FROM cls QUALIFY row_number() OVER (PARTITION BY query_id, ticker ORDER BY final_rank NULLS LAST, pool_pos NULLS LAST, scope_excluded, least(rank, lrank), doc_id) = 1",
    "gold_summary": f"""WITH {_OKAPI}, {_STATS}, r AS (SELECT class, doc_id % 2 = 0 AS own_period FROM cls)
SELECT own_period, class, count(*) AS n, floor(avg((class = 'hit')::INTEGER::DOUBLE) * 1e6 + 0.5) / 1e6 AS hit_rate FROM (SELECT own_period, class FROM r) GROUP BY ROLLUP (own_period, class)""",
    "number_tolerance_join": """WITH f AS (SELECT DISTINCT doc_id, d::DOUBLE AS found FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS d FROM documents) WHERE length(d) BETWEEN 4 AND 9),
p AS (SELECT DISTINCT floor(p_retailprice * 100 + 0.5)::DOUBLE AS expected FROM part)
SELECT doc_id, found, count(*) AS n, min(expected) AS least, max(expected) AS most FROM f JOIN p ON abs(found - expected) <= greatest(abs(expected) * 0.01, 0.05) GROUP BY 1, 2""",
    "derivation_eval": "SELECT l_returnflag, floor((l_extendedprice * (1.0::DOUBLE - l_discount) - l_extendedprice) / abs(l_extendedprice) * 100 * 100 + 0.5) / 100 AS pct, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "corner_spread": """WITH v AS (SELECT p_partkey, (p_retailprice + a * 0.05::DOUBLE) / nullif(p_size + b * 0.5::DOUBLE, 0) AS x FROM part, (VALUES (-1), (1)) AS s(a), (VALUES (-1), (1)) AS t(b))
SELECT p_partkey, floor(min(x) * 1e6 + 0.5) / 1e6 AS low, floor(max(x) * 1e6 + 0.5) / 1e6 AS high FROM v GROUP BY 1""",
    "printed_figures": """WITH p AS (SELECT DISTINCT floor(p_retailprice / 10 + 0.5)::BIGINT AS p FROM part), l AS (SELECT l_extendedprice AS e, floor(l_extendedprice / 10 + 0.5)::BIGINT AS p FROM lineitem)
SELECT p, count(*) AS n FROM l JOIN p USING (p) WHERE abs(e - p * 10.0::DOUBLE) <= 0.5 * 10 + 1e-9 * abs(p * 10.0::DOUBLE) GROUP BY 1""",
    "number_format": "SELECT regexp_replace(regexp_replace((l_extendedprice * 100)::DECIMAL(38, 6)::VARCHAR, '0+$', ''), '[.]$', '') AS printed, count(*) AS n FROM lineitem GROUP BY 1",
    "period_labels": """WITH o AS (SELECT o_orderdate::DATE AS d, o_orderpriority LIKE '1%' AS k, year(o_orderdate) + (month(o_orderdate) > 9)::INTEGER AS fy, (month(o_orderdate) - 9 - 1 + 24) % 12 // 3 + 1 AS q FROM orders)
SELECT CASE WHEN k THEN 'fiscal year ' || fy ELSE 'Q' || q || ' of fiscal year ' || fy END || ', ended ' || strftime(d, '%B %-d, %Y') AS label, count(*) AS n FROM o GROUP BY 1""",
    "rate_limiter_fixed_window": """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS ord, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT key, ord, i, t AS start, 1 AS used, true AS allowed FROM e WHERE i = 1 UNION ALL
SELECT e.key, e.ord, e.i, CASE WHEN e.t - w.start >= 86400000000 THEN e.t ELSE w.start END, CASE WHEN e.t - w.start >= 86400000000 THEN 1 WHEN w.used < 3 THEN w.used + 1 ELSE w.used END, e.t - w.start >= 86400000000 OR w.used < 3 FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1)
SELECT key, ord, allowed FROM w""",
}
