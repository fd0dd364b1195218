"""Sources, stores and logs: tables are written in the shapes that arrive from outside and read by the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numeric import rounded
from factloom.operators import bm25, formulas, replay
from factloom.plans.fact_queries import NATION_SQL, nation_facts
from factloom.plans.retrieval_queries import QUESTIONS
from factloom.sources import jsonl
from factloom.sources.score_store import ScoreStore, cached_scores
from factloom.sources.shared import new_folder
from factloom.sources.submission_source import SubmissionSource
from factloom.sources.submissions import COLUMNS
from factloom.sources.tables import table
from factloom.streaming.log import TraceLog, log_stream
from factloom.streaming.tail import tail


def submissions_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as filing lists, a page a year; annual and quarterly ones from 1998 on, with the filters in the reader."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    form = F.when(F.col("o_orderstatus") == "P", "10-K").when(F.col("o_orderstatus") == "F", "10-Q").otherwise("8-K")
    entry = F.struct((-F.col("o_orderkey")).alias("k"), *(c.alias(n) for n, c in zip(COLUMNS, (form, F.col("o_orderkey").cast("string"), F.col("filed"), F.col("o_orderpriority"), F.col("filed")), strict=True)))
    pages = orders.groupBy("o_custkey", "year").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    page = F.to_json(F.struct(*(F.col("rows")[c].alias(c) for c in COLUMNS)))
    folder = new_folder(spark, "pages")
    placed = pages.select(F.col("o_custkey").cast("string").alias("ticker"), (F.lit(9999) - F.col("year")).alias("page"), page.alias("json")).repartition("ticker").sortWithinPartitions("ticker", "page")
    placed.select(F.concat_ws("\t", "ticker", "page", "json").alias("value")).write.text(folder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # read when the plan is made
    spark.dataSource.register(SubmissionSource)
    found = spark.read.format("submissions").load(folder).where(F.col("form").isin("10-K", "10-Q") & (F.col("filingDate") >= "1998-01-01"))
    return found.select("ticker", *COLUMNS)


def numbered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines that know their place in their file, read with line numbers: per language how many come out right."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    folder = new_folder(spark, "lines")
    docs.select(F.to_json(F.struct(place.alias("n"), "doc_id", "lang", "text")).alias("value")).write.text(folder)
    rows = jsonl.read_strict(spark, folder, "n long, doc_id long, lang string, text string", ("n", "doc_id"), numbered=True)
    return rows.groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(F.col("n") == F.col("line")).alias("n_right"))


def score_store_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as calls of a scorer, a pair a line; all are scored once, one language is edited, then all are asked for again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = F.transform(F.split("text", "\n"), lambda line: F.struct(F.col("lang").alias("query"), line.alias("text")))
    scorer = lambda calls: calls.select("key", F.transform("pairs", lambda p: F.length(p["text"]).cast("double")).alias("scores"))
    store = ScoreStore(spark, new_folder(spark, "scores"))
    cached_scores(docs.select(pairs.alias("pairs")), scorer, store)
    edited = docs.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit("\n!"))).otherwise(F.col("text")))
    served = cached_scores(edited.select(pairs.alias("pairs")), scorer, store)
    total = F.sum(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x)).cast("long")
    return served.scores.agg(F.count("*").alias("n_calls"), total.alias("total")).withColumns({"hits": F.lit(served.hits).cast("long"), "misses": F.lit(served.misses).cast("long")})


def trace_log_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace lines, tailed into the log by a stream that then starts again from nothing, as after the loss of its checkpoint."""
    events = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("category"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))).alias("value"))
    lines, log = new_folder(spark, "events"), new_folder(spark, "log")
    events.repartition(4).write.text(lines)
    for attempt in ("first", "again"):
        stream = tail(spark, lines, files=2).select("run_id", "kind", "timestamp")
        log_stream(stream, log, new_folder(spark, f"stream-{attempt}")).awaitTermination()
    records = TraceLog(spark, log).records(stream.schema)
    return records.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds"), F.min("timestamp").alias("first"))


METRICS = ("revenue", "gross_margin", "net_income", "unheard_of")
OPERATIONS = ("add", "subtract", "multiply", "divide", "percent_of", "percent_change")
TOOLS = {"click": "get_financial_fact", "purchase": "calculate", "view": "compare_financial_metric", "signup": "search_filings", "error": "shell"}
LANGS = ("en", "fr", "de", "none")


def _pick(values: tuple[str, ...], n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged calls of users: clicks ask for facts of nations, purchases calculate, views compare, signups search."""
    n, k = F.col("event_id"), F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    tool = F.create_map(*(F.lit(x) for pair in TOOLS.items() for x in pair))[F.col("event_type")]
    args = F.to_json(F.struct(
        (n % 25).cast("string").alias("ticker_of_fact"), _pick(METRICS, n).alias("metric"), (F.lit(1995) + n % 9).alias("fiscal_year"), _pick(OPERATIONS, n).alias("operation"), F.floor("value").alias("operand_a"), k.alias("operand_b"),
        _pick(tuple(q for _, q in QUESTIONS), n).alias("query"), _pick(LANGS, n).alias("lang"),
    ))
    named = F.when(F.col("tool") == "search_filings", F.replace(args, F.lit('"lang"'), F.lit('"ticker"'))).otherwise(F.replace(args, F.lit('"ticker_of_fact"'), F.lit('"ticker"')))
    logged = F.try_parse_json(F.lit('{"found": true, "result_count": 25}'))
    calls = table(spark, sf_dir, "events").withColumn("tool", tool).select(F.col("user_id").alias("run_id"), n.alias("ord"), "tool", F.when(n % 50 == 0, F.try_parse_json(F.lit("[]"))).otherwise(F.try_parse_json(named)).alias("args"), logged.alias("logged"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")

    def search(searches: DataFrame) -> DataFrame:
        asked = searches.select("query").distinct().withColumn("query_id", F.col("query"))
        counts = bm25.bm25_by_partition(docs, asked, "lang").where("score > 0").groupBy("query_id", "lang").agg(F.least(F.count("*"), F.lit(25)).alias("result_count"))
        return counts.select(F.col("query_id").alias("query"), F.col("lang").alias("ticker"), "result_count")

    resolved = nation_facts(spark, sf_dir).withColumn("entity", F.col("entity").cast("string"))
    return replay.replayed(calls, resolved, formulas.registry(spark), search)


def replay_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each logged call gives when it is made again."""
    got = lambda name, kind: F.try_variant_get("replayed", f"$.{name}", kind)
    companies = F.array_join(F.array_sort(got("companies", "array<string>")), ",")
    return _replay(spark, sf_dir).select("run_id", "ord", "tool", "error", got("found", "boolean").alias("found"), rounded(got("value", "double"), 4).alias("value"), companies.alias("companies"), got("result_count", "bigint").alias("result_count"))


def replay_run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run its first error and how many calls before it came out otherwise than logged."""
    return replay.run_outcomes(_replay(spark, sf_dir))


QUERIES = {f.__name__: f for f in (submissions_scan, numbered_scan, score_store_reuse, trace_log_exactly_once, replay_calls, replay_run_outcomes)}

_ARRAY = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_REPLAY_SQL = f"""{NATION_SQL},
ev AS (SELECT user_id AS run_id, event_id AS ord, event_type AS t, event_id AS n, floor(value) AS a, regexp_extract(props, '[0-9]+')::DOUBLE AS b, event_id % 50 = 0 AS bad FROM events),
margins AS (SELECT entity, fy, max(value) FILTER (metric = 'gross_profit') AS x, max(value) FILTER (metric = 'revenue') AS y FROM resolved GROUP BY 1, 2),
vals AS (SELECT entity, fy, metric, value FROM resolved UNION ALL SELECT entity, fy, 'gross_margin', floor(x / y * 100 * 10 + 0.5) / 10 FROM margins WHERE y <> 0),
lists AS (SELECT fy, metric, string_agg(entity::VARCHAR, ',' ORDER BY entity::VARCHAR) AS companies FROM vals GROUP BY 1, 2),
qs(i, query) AS (VALUES {", ".join(f"({i}, '{q}')" for i, (_, q) in enumerate(QUESTIONS))}),
words AS (SELECT i, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM qs),
counts AS (SELECT i, lang, least(count(DISTINCT doc_id), 25) AS result_count FROM words JOIN (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS term FROM documents) USING (term) GROUP BY 1, 2),
args AS (SELECT *, {_ARRAY(METRICS)}[n % 4 + 1] AS metric, 1995 + n % 9 AS fy, {_ARRAY(OPERATIONS)}[n % 6 + 1] AS op, {_ARRAY(LANGS)}[n % 4 + 1] AS lang, map({_ARRAY(TOOLS)}, {_ARRAY(TOOLS.values())})[t] AS tool FROM ev),
done AS (
  SELECT run_id, ord, tool, CASE WHEN t = 'error' THEN 'no replay route for tool shell' WHEN bad THEN 'arguments are no object' END AS error, f.value AS fact, l.companies AS cs, coalesce(c.result_count, 0) AS rc,
    CASE op WHEN 'add' THEN a + b WHEN 'subtract' THEN a - b WHEN 'multiply' THEN a * b WHEN 'divide' THEN CASE WHEN b <> 0 THEN floor(a / b * 100 + 0.5) / 100 END
      WHEN 'percent_of' THEN CASE WHEN b <> 0 THEN floor(a / b * 100 * 10 + 0.5) / 10 END ELSE CASE WHEN b <> 0 THEN floor((a - b) / abs(b) * 100 * 10 + 0.5) / 10 END END AS calc
  FROM args LEFT JOIN vals f ON t = 'click' AND f.entity = n % 25 AND f.fy = args.fy AND f.metric = args.metric LEFT JOIN lists l ON t = 'view' AND l.fy = args.fy AND l.metric = args.metric
    LEFT JOIN counts c ON t = 'signup' AND c.i = n % {len(QUESTIONS)} AND c.lang = args.lang
), outs AS (
  SELECT run_id, ord, tool, error, CASE WHEN error IS NULL AND tool <> 'search_filings' THEN CASE tool WHEN 'get_financial_fact' THEN fact IS NOT NULL WHEN 'calculate' THEN calc IS NOT NULL ELSE cs IS NOT NULL END END AS found,
    CASE WHEN error IS NULL THEN CASE tool WHEN 'get_financial_fact' THEN fact WHEN 'calculate' THEN calc END END AS value, CASE WHEN error IS NULL AND tool = 'compare_financial_metric' THEN cs END AS companies,
    CASE WHEN error IS NULL AND tool = 'search_filings' THEN rc END AS result_count FROM done)"""

ORACLES = {
    "submissions_scan": """SELECT o_custkey::VARCHAR AS ticker, CASE o_orderstatus WHEN 'P' THEN '10-K' ELSE '10-Q' END AS form, o_orderkey::VARCHAR AS accessionNumber, strftime(o_orderdate, '%Y-%m-%d') AS filingDate, o_orderpriority AS primaryDocument, strftime(o_orderdate, '%Y-%m-%d') AS reportDate
FROM orders WHERE o_orderstatus IN ('P', 'F') AND o_orderdate >= DATE '1998-01-01'""",
    "numbered_scan": "SELECT lang, count(*) AS n_lines, count(*) AS n_right FROM documents GROUP BY 1",
    "score_store_reuse": """WITH d AS (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents), e AS (SELECT DISTINCT lang, text || CASE WHEN lang = 'fr' THEN chr(10) || '!' ELSE '' END AS text FROM d)
SELECT count(*) AS n_calls, sum(length(replace(e.text, chr(10), '')))::BIGINT AS total, count(o.lang) AS hits, count(*) - count(o.lang) AS misses FROM e LEFT JOIN (SELECT DISTINCT lang, text FROM d) o ON o.lang = e.lang AND o.text = e.text""",
    "trace_log_exactly_once": """SELECT user_id::VARCHAR AS run_id, count(*) AS n, count(DISTINCT event_type) AS kinds, min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS first FROM events GROUP BY 1""",
    "replay_calls": f"WITH {_REPLAY_SQL} SELECT run_id, ord, tool, error, found, floor(value * 1e4 + 0.5) / 1e4 AS value, companies, result_count FROM outs",
    "replay_run_outcomes": f"""WITH {_REPLAY_SQL}, drifts AS (SELECT run_id, ord, error, error IS NULL AND (coalesce(NOT found, false) OR value IS NOT NULL OR companies IS NOT NULL OR coalesce(result_count <> 25, false)) AS drift FROM outs),
ends AS (SELECT run_id, count(*) AS calls, min(ord) FILTER (error IS NOT NULL) AS e FROM drifts GROUP BY 1)
SELECT run_id, calls, any_value(error) FILTER (ord = e) AS error, count(*) FILTER (drift AND (e IS NULL OR ord < e)) AS drift FROM drifts JOIN ends USING (run_id) GROUP BY run_id, calls""",
}
