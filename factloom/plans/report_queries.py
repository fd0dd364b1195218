"""Operators on calculations, replays and reports, on order lines, events and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import reports, verification
from factloom.sources.shared import written
from factloom.sources.tables import table


def operand_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an answer, its lines in order are results that hold a quantity, a discount in percent and a price; each line
    claims one operand, rightly or in one of four wrong ways."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_extendedprice"))).alias("lines"))
    each = lines.select(F.col("l_orderkey").alias("answer_id"), F.size("lines").alias("n_results"), F.posexplode("lines").alias("pos", "x")).withColumn("idx", F.col("pos") + 1)
    each = written(each, "lines")  # read three times; collecting an order's lines shuffles all of them
    kind = F.col("x.l_partkey") % 5
    value = F.when(kind == 0, F.col("x.l_quantity")).when(kind == 1, F.col("x.l_discount") * 100).when(kind == 2, F.col("x.l_extendedprice")).when(kind == 3, F.col("x.l_extendedprice") / 1000).otherwise(1e9)
    operands = each.select("answer_id", F.col("idx").alias("operand"), value.alias("value"), F.when(kind == 3, "thousand").otherwise("raw").alias("unit"), F.when(kind == 2, F.col("idx") + 1).otherwise(F.col("idx")).alias("citation_index"))
    held = F.explode(F.array(F.struct(F.col("x.l_quantity").alias("value"), F.lit("raw").alias("unit")), F.struct((F.col("x.l_discount") * 100).alias("value"), F.lit("percent").alias("unit")), F.struct(F.col("x.l_extendedprice").alias("value"), F.lit("raw").alias("unit"))))
    found = each.select("answer_id", "idx", held.alias("h")).select("answer_id", "idx", "h.value", "h.unit")
    return verification.operand_grounding(operands, each.where("idx = 1").select("answer_id", "n_results"), found)


def question_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, every third one marked to be skipped."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), (F.col("item_id") % 3 == 0).alias("skip"))
    return reports.select_questions(questions)


def observed_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replayed calls: errors are calculations, purchases searches, clicks comparisons, all others have no route."""
    tool = F.when(F.col("event_type") == "error", "calculate").when(F.col("event_type") == "purchase", "search_filings").when(F.col("event_type") == "click", "compare_financial_metric").otherwise("shell")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    output = lambda n: F.try_parse_json(F.format_string('{"value": %d, "result_count": %d, "found": true, "companies": [%d], "other": %d}', n, F.floor(n / 10), F.floor(n / 50), F.col("event_id")))
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), tool.alias("tool"), output(k).alias("logged"), output(k + F.col("event_id") % 4).alias("replayed"))
    return reports.observed_differences(calls)


def base_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reports: balance and segment stand for digests of gold and corpus; the base was made of their neighbours."""
    c = table(spark, sf_dir, "customer")
    sha = F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    now = c.select(F.col("c_custkey").alias("report"), (F.col("c_nationkey") % 2).cast("string").alias("gold_sha"), sha.alias("corpus_sha"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3 == 1).alias("index_matches"))
    out = reports.base_verdict(now.withColumn("report", F.col("report") + 1), now)
    return out.select("report", "refused", F.array_join("notes", ",").alias("notes"))


def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source blocks of orders as facts, some without a form, a filing date or an address."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    block = reports.fact_source(F.col("o_custkey").cast("string"), day, F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 3 == 0, day), F.when(F.col("o_orderkey") % 5 == 0, F.lit("file:")))
    return o.select("o_orderkey", block.alias("source"))


def printable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all but printable ASCII escaped, by digest, and the length of the text clipped at 200."""
    shown = reports.printable(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(shown).alias("n"), F.sha2(shown, 256).alias("sha"), F.length(reports.clipped(shown, 200)).alias("n_clipped"))


QUERIES = {f.__name__: f for f in (operand_grounding, question_select, observed_differences, base_verdict, fact_sources, printable_texts)}

ORACLES = {
    "operand_grounding": """WITH l AS (SELECT *, l_orderkey AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount, l_extendedprice)::INTEGER AS idx, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey % 5 AS k FROM lineitem),
o AS (SELECT a, idx AS operand, n, CASE k WHEN 0 THEN l_quantity WHEN 1 THEN l_discount * 100 WHEN 2 THEN l_extendedprice WHEN 3 THEN l_extendedprice / 1000 ELSE 1e9 END AS v, CASE k WHEN 3 THEN 'thousand' ELSE 'raw' END AS unit, CASE k WHEN 2 THEN idx + 1 ELSE idx END AS cited FROM l),
h AS (SELECT a, idx, false AS pct, l_quantity AS w FROM l UNION ALL SELECT a, idx, true, l_discount * 100 FROM l UNION ALL SELECT a, idx, false, l_extendedprice FROM l),
u(no, name, f) AS (VALUES (0, 'raw', 1e0), (1, 'thousand', 1e3), (2, 'million', 1e6), (3, 'billion', 1e9), (4, 'percent', 1e0)),
t AS (SELECT o.a, operand, unit, cited, no, name, idx FROM o CROSS JOIN u JOIN h ON h.a = o.a AND pct = (name = 'percent') AND abs(w - v * f) <= greatest(0.01::DOUBLE * abs(v * f), 0.05::DOUBLE)),
s AS (SELECT a, operand, bool_or(name = unit AND idx = cited) AS ok, min(no) FILTER (name <> unit AND idx = cited) AS no, min(idx) FILTER (name = unit AND idx <> cited) AS other FROM t GROUP BY 1, 2),
r AS (SELECT a, operand, no, other, CASE WHEN cited > n THEN 'bad_index' WHEN ok THEN 'ok' WHEN no IS NOT NULL THEN 'wrong_unit' WHEN other IS NOT NULL THEN 'wrong_index' ELSE 'ungroundable' END AS outcome FROM o LEFT JOIN s USING (a, operand))
SELECT a AS answer_id, operand, outcome, CASE WHEN outcome = 'wrong_unit' THEN name END AS other_unit, CASE WHEN outcome = 'wrong_index' THEN other END AS other_index FROM r LEFT JOIN u USING (no)""",
    "question_select": "SELECT item_id::VARCHAR AS id, item_id % 3 = 0 AS skip FROM benchmark WHERE item_id % 3 <> 0",
    "observed_differences": """WITH c AS (SELECT user_id AS run_id, event_id AS ord, CASE event_type WHEN 'error' THEN 'calculate' WHEN 'purchase' THEN 'search_filings' WHEN 'click' THEN 'compare_financial_metric' ELSE 'shell' END AS tool,
  regexp_extract(props, '[0-9]+')::BIGINT AS k, regexp_extract(props, '[0-9]+')::BIGINT + event_id % 4 AS m FROM events)
SELECT run_id, ord, tool, CASE tool WHEN 'calculate' THEN 'value' WHEN 'search_filings' THEN 'result_count' WHEN 'compare_financial_metric' THEN 'companies' ELSE 'no_route' END AS field,
  CASE tool WHEN 'calculate' THEN k::VARCHAR WHEN 'search_filings' THEN (k // 10)::VARCHAR WHEN 'compare_financial_metric' THEN '[' || k // 50 || ']' END AS logged,
  CASE tool WHEN 'calculate' THEN m::VARCHAR WHEN 'search_filings' THEN (m // 10)::VARCHAR WHEN 'compare_financial_metric' THEN '[' || m // 50 || ']' END AS replayed
FROM c WHERE tool = 'shell' OR logged <> replayed""",
    "base_verdict": """WITH r AS (SELECT c_custkey AS k, c_nationkey % 2 AS gold, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS sha, c_custkey % 3 AS i FROM customer)
SELECT c.k AS report, b.gold <> c.gold AS refused, concat_ws(',', CASE WHEN c.sha IS NULL THEN 'corpus_unknown' END,
  CASE WHEN b.sha IS NULL THEN 'base_corpus_unknown' WHEN c.sha IS NOT NULL AND b.sha <> c.sha THEN 'corpus_differs' END, CASE WHEN b.i = 2 THEN 'base_index_stale' END, CASE WHEN c.i = 2 THEN 'index_stale' END) AS notes FROM r c JOIN r b ON b.k + 1 = c.k""",
    "fact_sources": """SELECT o_orderkey, '{"ticker":"' || o_custkey || '","period_end":"' || strftime(o_orderdate, '%Y-%m-%d') || '","accession":"' || o_orderkey || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"form":"' || o_orderstatus || '"' ELSE '' END
|| CASE WHEN o_orderkey % 3 = 0 THEN ',"filed":"' || strftime(o_orderdate, '%Y-%m-%d') || '"' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ',"sec_url":"file:"' ELSE '' END || '}' AS source FROM orders""",
    "printable_texts": r"""WITH p AS (SELECT doc_id, array_to_string([CASE WHEN c = '' OR (unicode(c) BETWEEN 32 AND 126) THEN c WHEN unicode(c) = 9 THEN '\t' WHEN unicode(c) = 10 THEN '\n' WHEN unicode(c) = 13 THEN '\r'
  WHEN unicode(c) < 256 THEN printf('\x%02x', unicode(c)) WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c)) ELSE printf('\U%08x', unicode(c)) END FOR c IN string_split(coalesce(text, ''), '')], '') AS s FROM documents)
SELECT doc_id, length(coalesce(s, ''))::INTEGER AS n, sha256(coalesce(s, '')) AS sha, CASE WHEN length(coalesce(s, '')) > 200 THEN 203 ELSE length(coalesce(s, '')) END::INTEGER AS n_clipped FROM p""",
}
