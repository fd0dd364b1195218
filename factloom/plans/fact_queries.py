"""Fact operators on the star schema: order lines play re-reported facts of customers.

entity := o_custkey, metric := l_returnflag, tag := l_linestatus, end := l_shipdate, start and filed := o_orderdate, fp := FY for
urgent orders, else the quarter; form := 10-K or 10-Q likewise; frame := quarter of the ship date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numeric import rounded
from factloom.operators import facts as facts_ops
from factloom.operators import formulas
from factloom.operators import requests as request_ops
from factloom.sources.shared import written
from factloom.sources.tables import table


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("end"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("start"))
    annual = F.col("o_orderpriority").startswith("1")
    return lines.join(orders, "l_orderkey").select(
        F.col("o_custkey").alias("entity"), F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("tag"), F.lit("USD").alias("unit"),
        # the order of reporting; price and quantity settle lines that share a number
        (F.col("l_orderkey").cast("double") * 1e9 + F.col("l_linenumber") * 1e8 + F.col("l_extendedprice") * 100).alias("ord"),
        "start", "end", F.col("l_extendedprice").alias("val"), F.col("l_orderkey").cast("string").alias("accn"),
        F.year("start").alias("fy"), F.when(annual, "FY").otherwise(F.concat(F.lit("Q"), F.quarter("start").cast("string"))).alias("fp"),
        F.when(annual, "10-K").otherwise("10-Q").alias("form"), F.col("start").alias("filed"),
        F.concat(F.lit("CY"), F.year("end").cast("string"), F.lit("Q"), F.quarter("end").cast("string")).alias("frame"),
    )


FACTS_SQL = """facts AS (
  SELECT o_custkey AS entity, l_returnflag AS metric, l_linestatus AS tag, l_orderkey::DOUBLE * 1e9 + l_linenumber * 1e8 + l_extendedprice * 100 AS ord,
    o_orderdate::DATE AS start, l_shipdate::DATE AS "end", l_extendedprice AS val, l_orderkey::VARCHAR AS accn, year(o_orderdate)::INTEGER AS fy,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'FY' ELSE 'Q' || quarter(o_orderdate) END AS fp, CASE WHEN o_orderpriority LIKE '1%' THEN '10-K' ELSE '10-Q' END AS form,
    o_orderdate::DATE AS filed, 'CY' || year(l_shipdate) || 'Q' || quarter(l_shipdate) AS frame, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def fact_pick_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_ops.pick_period(order_facts(spark, sf_dir)).select("entity", "metric", "fy", "fp", "end", "val", "accn")


def fact_pick_end_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_ops.pick_end_date(order_facts(spark, sf_dir)).select("entity", "metric", "end", "bucket", "val", "accn")


def fact_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_ops.pick_latest(order_facts(spark, sf_dir)).select("entity", "metric", "end", "val", "accn")


def fact_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks three ways for each metric: at the end date of its first line, the latest, and by period."""
    # read four times; without a broadcast each would shuffle all lines by order
    facts = written(order_facts(spark, sf_dir).select("entity", "metric", "unit", "ord", "start", "end", "val", "accn", "fy", "fp", "form", "filed", "frame"), "facts")
    base = facts.groupBy("entity", "metric").agg(F.min("end").alias("first_end"), F.max("fy").alias("last_fy"))
    null = F.lit(None)
    asked = [
        base.select("entity", "metric", null.cast("int").alias("fy"), null.cast("string").alias("fp"), F.col("first_end").cast("string").alias("period_end"), F.lit("end").alias("way")),
        base.select("entity", "metric", null.cast("int").alias("fy"), null.cast("string").alias("fp"), F.lit("").alias("period_end"), F.lit("latest").alias("way")),
        base.select("entity", "metric", F.col("last_fy").alias("fy"), F.lit("FY").alias("fp"), null.cast("string").alias("period_end"), F.lit("period").alias("way")),
    ]
    requests = asked[0].unionByName(asked[1]).unionByName(asked[2]).withColumn("request_id", F.concat_ws("-", F.col("entity").cast("string"), "metric", "way"))
    return facts_ops.get_metric(facts, requests).select("request_id", "val", "end", "accn")


def frame_merge_designated_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_facts(spark, sf_dir).where("metric = 'R'").withColumn("designated", F.when(F.col("entity") % 2 == 0, "F").otherwise("O"))
    return facts_ops.merge_frame(rows).select("entity", "frame", "tag", "val", "conflict")


def compare_all_entities_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of the anchor's period value, then every entity's value in that frame; the anchor is the smallest customer with an annual value."""
    facts = order_facts(spark, sf_dir).where("metric = 'A'")
    anchor = facts_ops.pick_period(facts).where("fp = 'FY'").orderBy("entity", "fy").limit(1).select("frame")
    rows = facts.join(F.broadcast(anchor), "frame").withColumn("designated", F.lit("O"))  # one row
    return facts_ops.merge_frame(rows).select("entity", "frame", "tag", "val")


def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag of each nation's market segments: the segment's first nation by default, with one override."""
    requests = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("entity"), F.col("c_mktsegment").alias("metric")).distinct()
    defaults = requests.groupBy("metric").agg(F.concat(F.lit("T"), F.min("entity").cast("string")).alias("tag"))
    overrides = requests.where("entity = 3").select("entity", "metric", F.concat(F.lit("own-"), "metric").alias("tag"))
    return facts_ops.tag_of(requests, defaults, overrides).select("entity", "metric", "tag")


def nation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved yearly facts of nations: revenue, gross_profit (after discount and tax), net_income, total_assets."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("fy"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"))
    cents = lambda c: F.sum(F.floor(c * 100 + 0.5).cast("long"))  # noqa: E731  exact sums, whatever their order
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = lines.join(orders, "l_orderkey").join(customers, "o_custkey").groupBy("entity", "fy").agg(
        cents(F.col("l_extendedprice")).alias("revenue"), cents(net).alias("gross_profit"), cents(net * (1 - F.col("l_tax"))).alias("net_income"), cents(F.col("l_quantity") * 1000).alias("total_assets"),
    )
    stack = "stack(4, 'revenue', revenue, 'gross_profit', gross_profit, 'net_income', net_income, 'total_assets', total_assets) AS (metric, cents)"
    return sums.select("entity", "fy", F.expr(stack)).select("entity", "fy", F.lit("FY").alias("fp"), "metric", (F.col("cents") / 100.0).alias("value"), F.make_date("fy", F.lit(12), F.lit(31)).alias("end"))


NATION_SQL = """sums AS (
  SELECT c_nationkey AS entity, year(o_orderdate)::INTEGER AS fy, sum(floor(l_extendedprice * 100 + 0.5)::BIGINT) AS revenue, sum(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5)::BIGINT) AS gross_profit,
    sum(floor(l_extendedprice * (1 - l_discount) * (1 - l_tax) * 100 + 0.5)::BIGINT) AS net_income, sum(floor(l_quantity * 1000 * 100 + 0.5)::BIGINT) AS total_assets
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
), resolved AS (
  SELECT entity, fy, 'FY' AS fp, metric, cents::DOUBLE / 100.0 AS value FROM sums UNPIVOT (cents FOR metric IN (revenue, gross_profit, net_income, total_assets)))"""


def ratio_same_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.ratios(nation_facts(spark, sf_dir), formulas.registry(spark)).select("entity", "fy", "fp", "ratio", "value")


def ratio_cross_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = nation_facts(spark, sf_dir).where("fy = 1997").select("entity", "metric", "value", "end")
    return formulas.ratios_across(frame, formulas.registry(spark)).select("entity", "ratio", "value")


def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.yoy_growth(nation_facts(spark, sf_dir)).select("entity", "metric", "fp", "fy", "growth")


def multi_year_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = nation_facts(spark, sf_dir)
    asked = resolved.select("entity", "metric").distinct().select(F.concat_ws("-", F.col("entity").cast("string"), "metric").alias("request_id"), "entity", "metric", F.lit(1996).alias("first_year"), F.lit(1999).alias("last_year"))
    return formulas.multi_year_average(resolved, asked).select("request_id", "n", rounded(F.col("mean"), 6).alias("mean"))


def _tool_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every nation asks for an average, a growth, a ratio, a metric and an unknown metric; answers and what is unmet."""
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(m).alias("metric"), F.lit(a).cast("int").alias("first_year"), F.lit(b).cast("int").alias("last_year"), F.lit(g).alias("growth"))
        for k, m, a, b, g in (("a", "net_margin", 1996, 1998, False), ("g", "revenue", None, None, True), ("r", "asset_turnover", None, None, False), ("m", "net_income", None, None, False), ("u", "goodwill", None, None, False), ("z", "revenue", 1980, 1998, False))
    ])).alias("r")).select(F.concat_ws("-", F.col("entity").cast("string"), "r.kind").alias("request_id"), "entity", "r.metric", F.lit(1998).alias("fy"), F.lit("FY").alias("fp"), "r.first_year", "r.last_year", "r.growth")
    return request_ops.answer(asked, nation_facts(spark, sf_dir), formulas.registry(spark))


def fact_router_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tool_requests(spark, sf_dir)[0]


def fact_router_unmet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tool_requests(spark, sf_dir)[1]


def calculate_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six operations on every part's price and size; a size of a part may be zero after the shift."""
    from factloom.functions.numeric import calculate

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.col("p_size") - 10).cast("double").alias("b"))
    ops = F.explode(F.array(*[F.lit(o) for o in ("add", "subtract", "multiply", "divide", "percent_of", "percent_change")])).alias("operation")
    unit = F.when(F.col("p_partkey") % 10 == 9, "percent").when(F.col("p_partkey") % 10 == 8, "thousand").otherwise("raw")
    out = parts.withColumn("unit_b", unit).select("*", ops).withColumn("r", calculate(F.col("operation"), F.col("p_retailprice"), F.lit("raw"), F.col("b"), F.col("unit_b")))
    return out.select("p_partkey", "operation", rounded(F.col("r.value"), 2).alias("value"), F.col("r.error").alias("error"))


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw entries, some spoiled by rule; counts of the first failing check."""
    k = F.get_json_object("props", "$.k").cast("int")
    raw = table(spark, sf_dir, "events").select(
        F.when(k % 10 == 1, "2024-02-31").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("end"), F.when(k % 10 == 2, "Jan 1").otherwise("2024-01-01").alias("start"), (k % 2 == 0).alias("has_start"),
        F.when(k % 10 == 3, None).otherwise(F.col("value")).alias("val"), F.when(k % 10 == 4, "").otherwise(F.col("event_id").cast("string")).alias("accn"), F.when(k % 10 == 5, None).otherwise(F.col("event_type")).alias("form"),
        F.when(k % 10 == 6, "bad").otherwise(F.lit(None)).alias("filed"), F.when(k % 10 == 7, "20x4").otherwise("2024").alias("fy"),
    )
    return facts_ops.split_defects(raw)[1]


QUERIES = {f.__name__: f for f in (fact_pick_period, fact_pick_end_date, fact_latest, fact_requests, frame_merge_designated_tag, compare_all_entities_anchor, tag_lookup, ratio_same_period, ratio_cross_entity, yoy_growth, multi_year_average, fact_router_answers, fact_router_unmet, calculate_ops, reject_reasons)}

_PERIOD = """period AS (SELECT * FROM facts WHERE CASE WHEN fp = 'FY' THEN form = '10-K' AND days BETWEEN 350 AND 380 ELSE days BETWEEN 80 AND 100 END
  QUALIFY row_number() OVER (PARTITION BY entity, metric, fy, fp ORDER BY "end" DESC, filed DESC, ord) = 1)"""
_ENDS = """ends AS (SELECT *, CASE WHEN days BETWEEN 80 AND 100 THEN 1 ELSE 2 END AS bucket FROM facts WHERE days BETWEEN 80 AND 100 OR days BETWEEN 350 AND 380
  QUALIFY row_number() OVER (PARTITION BY entity, metric, "end" ORDER BY bucket, filed DESC, ord) = 1)"""
_LATEST = """latest AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY "end" DESC, days, filed DESC, ord) = 1)"""
_RATIOS = "(VALUES " + ", ".join(f"('{n}', '{a}', '{b}', {p}, {x})" for n, a, b, p, x in formulas.RATIOS) + ") AS d(ratio, numerator, denominator, as_percent, cross_company)"
_RATIO_VALUE = "CASE WHEN as_percent THEN floor(a.value / b.value * 100 * 10 + 0.5) / 10 ELSE floor(a.value / b.value * 100 + 0.5) / 100 END AS value"

ORACLES = {
    "fact_pick_period": f'WITH {FACTS_SQL}, {_PERIOD} SELECT entity, metric, fy, fp, "end", val, accn FROM period',
    "fact_pick_end_date": f'WITH {FACTS_SQL}, {_ENDS} SELECT entity, metric, "end", bucket::INTEGER AS bucket, val, accn FROM ends',
    "fact_latest": f'WITH {FACTS_SQL}, {_LATEST} SELECT entity, metric, "end", val, accn FROM latest',
    "fact_requests": f"""WITH {FACTS_SQL}, {_PERIOD}, {_ENDS}, {_LATEST}, base AS (SELECT entity, metric, min("end") AS first_end, max(fy) AS last_fy FROM facts GROUP BY 1, 2)
SELECT entity || '-' || metric || '-end' AS request_id, val, "end", accn FROM base JOIN ends USING (entity, metric) WHERE "end" = first_end
UNION ALL SELECT entity || '-' || metric || '-latest', val, "end", accn FROM latest
UNION ALL SELECT entity || '-' || metric || '-period', val, "end", accn FROM base JOIN period USING (entity, metric) WHERE fy = last_fy AND fp = 'FY'""",
    "frame_merge_designated_tag": f"""WITH {FACTS_SQL} SELECT entity, frame, tag, val, conflict FROM (
  SELECT *, min(tag) OVER w <> max(tag) OVER w AS conflict, row_number() OVER (PARTITION BY entity, frame ORDER BY (tag = CASE WHEN entity % 2 = 0 THEN 'F' ELSE 'O' END) DESC, tag, ord) AS r
  FROM facts WHERE metric = 'R' WINDOW w AS (PARTITION BY entity, frame)) WHERE r = 1""",
    "compare_all_entities_anchor": f"""WITH {FACTS_SQL}, {_PERIOD}, anchor AS (SELECT frame FROM period WHERE metric = 'A' AND fp = 'FY' ORDER BY entity, fy LIMIT 1)
SELECT entity, frame, tag, val FROM facts WHERE metric = 'A' AND frame = (SELECT frame FROM anchor)
QUALIFY row_number() OVER (PARTITION BY entity, frame ORDER BY (tag = 'O') DESC, tag, ord) = 1""",
    "tag_lookup": """WITH r AS (SELECT DISTINCT c_nationkey AS entity, c_mktsegment AS metric FROM customer), d AS (SELECT metric, 'T' || min(entity) AS tag FROM r GROUP BY 1)
SELECT entity, metric, CASE WHEN entity = 3 THEN 'own-' || metric ELSE tag END AS tag FROM r JOIN d USING (metric)""",
    "ratio_same_period": f"WITH {NATION_SQL} SELECT a.entity, a.fy, a.fp, ratio, {_RATIO_VALUE} FROM resolved a JOIN {_RATIOS} ON a.metric = numerator JOIN resolved b ON b.entity = a.entity AND b.fy = a.fy AND b.metric = denominator WHERE b.value <> 0",
    "ratio_cross_entity": f"WITH {NATION_SQL} SELECT a.entity, ratio, {_RATIO_VALUE} FROM resolved a JOIN {_RATIOS} ON a.metric = numerator AND cross_company JOIN resolved b ON b.entity = a.entity AND b.fy = a.fy AND b.metric = denominator WHERE b.value <> 0 AND a.fy = 1997",
    "yoy_growth": f"WITH {NATION_SQL} SELECT a.entity, a.metric, a.fp, a.fy, floor((a.value - b.value) / abs(b.value) * 100 * 10 + 0.5) / 10 AS growth FROM resolved a JOIN resolved b ON a.entity = b.entity AND a.metric = b.metric AND a.fy = b.fy + 1 WHERE b.value <> 0",
    "multi_year_average": f"WITH {NATION_SQL} SELECT entity || '-' || metric AS request_id, count(*) AS n, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean FROM resolved WHERE fy BETWEEN 1996 AND 1999 GROUP BY entity, metric HAVING count(*) = 4",
    "fact_router_answers": f"""WITH {NATION_SQL}, r AS (SELECT a.entity, a.fy, ratio, {_RATIO_VALUE}, a.value / b.value * 100 AS raw FROM resolved a JOIN {_RATIOS} ON a.metric = numerator JOIN resolved b ON b.entity = a.entity AND b.fy = a.fy AND b.metric = denominator WHERE b.value <> 0)
SELECT n_nationkey || '-a' AS request_id, 'average' AS route, floor(avg(raw) * 10 + 0.5) / 10 AS value FROM nation JOIN r ON entity = n_nationkey WHERE ratio = 'net_margin' AND fy BETWEEN 1996 AND 1998 GROUP BY 1 HAVING count(*) = 3
UNION ALL SELECT a.entity || '-g', 'growth', floor((a.value - b.value) / abs(b.value) * 100 * 10 + 0.5) / 10 FROM resolved a JOIN resolved b ON a.entity = b.entity AND a.metric = b.metric AND a.fy = b.fy + 1 WHERE b.value <> 0 AND a.metric = 'revenue' AND a.fy = 1998
UNION ALL SELECT entity || '-r', 'ratio', value FROM r WHERE ratio = 'asset_turnover' AND fy = 1998
UNION ALL SELECT entity || '-m', 'metric', value FROM resolved WHERE metric = 'net_income' AND fy = 1998""",
    "fact_router_unmet": f"""WITH {NATION_SQL}, have AS (SELECT DISTINCT entity FROM resolved WHERE fy = 1998), q AS (SELECT n_nationkey AS e, unnest(['a', 'g', 'r', 'm', 'u', 'z']) AS k FROM nation),
three AS (SELECT entity FROM resolved WHERE metric = 'revenue' AND fy BETWEEN 1996 AND 1998 GROUP BY 1 HAVING count(*) = 3), two AS (SELECT entity FROM resolved WHERE metric = 'revenue' AND fy BETWEEN 1997 AND 1998 GROUP BY 1 HAVING count(*) = 2)
SELECT e || '-' || k AS request_id, CASE k WHEN 'a' THEN 'net_margin' WHEN 'r' THEN 'asset_turnover' WHEN 'm' THEN 'net_income' WHEN 'u' THEN 'goodwill' ELSE 'revenue' END AS metric, CASE WHEN k = 'u' THEN 'unknown_metric' ELSE 'no_data_for_entity' END AS reason
FROM q WHERE k IN ('u', 'z') OR (k IN ('r', 'm') AND e NOT IN (SELECT entity FROM have)) OR (k = 'a' AND e NOT IN (SELECT entity FROM three)) OR (k = 'g' AND e NOT IN (SELECT entity FROM two))""",
    "calculate_ops": """WITH p AS (SELECT p_partkey, p_retailprice AS x, (p_size - 10)::DOUBLE AS y, CASE WHEN p_partkey % 10 = 9 THEN 'percent' WHEN p_partkey % 10 = 8 THEN 'thousand' ELSE 'raw' END AS u FROM part),
n AS (SELECT p_partkey, x, u, CASE WHEN u = 'thousand' THEN y * 1000.0 ELSE y END AS y, unnest(['add', 'subtract', 'multiply', 'divide', 'percent_of', 'percent_change']) AS operation FROM p),
e AS (SELECT *, CASE WHEN operation <> 'multiply' AND u = 'percent' THEN 'category_mismatch' WHEN operation IN ('divide', 'percent_of', 'percent_change') AND y = 0 THEN 'zero_divisor' END AS error FROM n)
SELECT p_partkey, operation, error, CASE WHEN error IS NULL THEN floor(CASE operation WHEN 'add' THEN x + y WHEN 'subtract' THEN x - y WHEN 'multiply' THEN x * y
  WHEN 'divide' THEN floor(x / nullif(y, 0) * 100 + 0.5) / 100 WHEN 'percent_of' THEN floor(x / nullif(y, 0) * 100 * 10 + 0.5) / 10 ELSE floor((x - y) / nullif(abs(y), 0) * 100 * 10 + 0.5) / 10 END * 100 + 0.5) / 100 END AS value FROM e""",
    "reject_reasons": """WITH e AS (SELECT (props->>'k')::INTEGER % 10 AS r, (props->>'k')::INTEGER % 2 = 0 AS has_start FROM events),
d AS (SELECT CASE WHEN r = 1 THEN 'bad_end' WHEN r = 2 AND has_start THEN 'bad_start' WHEN r = 3 THEN 'bad_val' WHEN r = 4 THEN 'bad_accn' WHEN r = 5 THEN 'bad_form' WHEN r = 6 THEN 'bad_filed' WHEN r = 7 THEN 'bad_fy' END AS defect FROM e)
SELECT defect, count(*) AS n FROM d WHERE defect IS NOT NULL GROUP BY 1""",
}
