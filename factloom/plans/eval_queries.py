"""Evaluation and trace operators on the event stream and the conversations.

A user's events are the runs of one question: passed := not an error, no answer := a signup, report := day. Events and turns are
trace records: run := user and day or conversation, kind := event type or role.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numeric import rounded
from factloom.operators import evalstats, trace
from factloom.sources.tables import table


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("qid"), F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd").alias("report"), (F.col("event_type") != "error").alias("passed"),
        F.when(F.col("event_type") != "signup", F.col("props")).alias("answer"), F.concat_ws(": ", "event_type", "props").alias("detail"), F.col("event_type").alias("type"),
        F.when(F.get_json_object("props", "$.k").cast("int") >= 10, F.concat(F.lit("c"), F.substring(F.get_json_object("props", "$.k"), 1, 1))).alias("category"),
        (F.col("value") > 5).alias("has_citation"), F.when(F.col("value") > 20, 1).otherwise(0).alias("n_warnings"),
        F.when(F.col("event_type") == "view", None).otherwise(F.col("value") > 15).alias("withheld"), F.when(F.col("event_type") == "click", None).otherwise(F.col("value") > 25).alias("would_have_passed"),
    )


def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.pass_rates(_runs(spark, sf_dir), "qid")


def flakiness_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.classify_histories(_runs(spark, sf_dir).where("answer is not null"))


def infra_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.truncate_at_infra_error(_runs(spark, sf_dir)).select("report", "ord", "qid")


def infra_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.excluded_counts(_runs(spark, sf_dir))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).where("answer is not null")
    return runs.withColumn("side", F.when(F.col("report") < "2024-01-16", "base").otherwise("candidate"))


def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.compare(_sides(spark, sf_dir)).select("qid", "base_runs", "candidate_runs", F.coalesce("base_passes", F.lit(0)).alias("base_passes"), F.coalesce("candidate_passes", F.lit(0)).alias("candidate_passes"), "presence", "change", "flags")


def ab_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.total_change(evalstats.compare(_sides(spark, sf_dir)))


def ab_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.consistency(_sides(spark, sf_dir), ["type", "category", "has_citation"])


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return customers.select(
        F.col("c_name").alias("report"), F.when(F.col("c_nationkey") == 0, None).otherwise(F.concat(F.lit("sha"), F.col("c_nationkey").cast("string"))).alias("git_sha"), F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_acctbal") > 9000).alias("git_dirty"),
        F.when(F.col("c_mktsegment") == "MACHINERY", None).otherwise(F.col("c_mktsegment") != "BUILDING").alias("snapshot_verified"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", None).otherwise(F.col("c_custkey") % 7 != 0).alias("index_matches_chunks"), F.col("c_nationkey").alias("fingerprint"),
    )


def report_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).where(~evalstats.is_excluded()).select("report", "fingerprint")


def report_default_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.default_pair(_reports(spark, sf_dir).where(~evalstats.is_excluded()))


def grouping_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.breakdown(_runs(spark, sf_dir))


def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalstats.gate_outcomes(_runs(spark, sf_dir))


def label_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents by language, by source and over all."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    lang, source = F.col("lang"), F.col("source")
    return joined.groupingSets([[lang], [source], []], lang, source).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("quality").alias("quality"))


def ab_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, passes and withheld answers of each side and question."""
    return evalstats.tally(_sides(spark, sf_dir))


def gate_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many wrongly refused rows each check has warned of; clicks come from before the gate's outcome was noted."""
    k = F.get_json_object("props", "$.k").cast("int")
    checks = F.array(F.concat(F.lit("c"), F.floor(k / 25).cast("string")), F.when(k % 2 == 1, "odd").otherwise("even"), F.concat(F.lit("c"), F.floor(k / 25).cast("string")))
    rows = _runs(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), checks.alias("checks")), "ord")
    return evalstats.false_positives_by_check(rows.withColumn("has_outcome", F.col("type") != "click").withColumn("type", F.when(F.col("type") == "error", "judged").otherwise("numeric")))


def replay_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as replayed runs: price and key say what was refused then and now, by which checks, and what drifted or failed."""
    n, price = F.col("o_orderkey"), F.col("o_totalprice")
    records = table(spark, sf_dir, "orders").select(
        F.when(n % 17 == 0, "boom").alias("error"), F.lit(None).cast("string").alias("base_error"), (n % 7 == 0).alias("drift"), (price > 200_000).alias("refused_then"), ((price > 250_000) | (n % 10 == 3)).alias("refused_now"),
        F.when(n % 3 > 0, (n % 3).cast("string")).alias("checks_then"), (n % 2 + 1).cast("string").alias("checks_now"), F.lit(None).cast("string").alias("messages_then"), F.lit("m").alias("messages_now"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("correct"),
    )
    return trace.replay_summary(records)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("run_id"),
        F.col("event_type").alias("kind"), F.col("event_type").alias("step"), F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"),
    )


def trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.count_by(_records(spark, sf_dir), "kind", "k")


def trace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = trace.matches("2024-01-05", "2024-01-20T12", ("error", "purchase"), equals={"missing": "None"})
    return _records(spark, sf_dir).where(rule).select("ord", "timestamp", "run_id", "kind")


def run_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.timelines(_records(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("ord"), "role", "text")


def run_final_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each conversation that repeats its last assistant text."""
    turns = _turns(spark, sf_dir)
    answers = turns.where("role = 'assistant'").groupBy("run_id").agg(F.max(F.struct("ord", "text")).alias("last")).select("run_id", F.col("last.text").alias("answer"))
    return trace.final_step(turns.join(answers, "run_id")).select("run_id", "ord", "role")


def run_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question ids of conversations by their first turn; each first text is a known question, named by the first conversation that asked it."""
    turns = _turns(spark, sf_dir)
    roots = turns.where("ord = 0").select("run_id", "ord", F.col("text").alias("question"))
    first = roots.groupBy("question").agg(F.min("run_id").cast("string").alias("id"), F.min("run_id").alias("ord"))
    return trace.question_ids(roots, first)


def replay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before and after a change of the gate: counts of each change."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    graded = F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus") == "F").alias("correct")
    base = orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("run_id"), (price > 200000).alias("withheld"), graded)
    new = orders.where("o_orderpriority <> '3-MEDIUM'").select(F.col("o_orderkey").alias("run_id"), (price > 250000).alias("withheld"), graded)
    new = new.withColumn("withheld", F.col("withheld") | (F.col("run_id") % 10 == 3))
    return trace.replay_outcomes(base, new).groupBy("presence", "change").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (wilson, flakiness_classify, infra_truncate, infra_errors, ab_compare, ab_total, ab_consistency, report_exclusion, report_default_pair, grouping_breakdown, gate_outcomes, label_breakdown, trace_counts, trace_filter, run_timeline, run_final_step, run_questions, replay_outcomes, ab_tally, gate_false_positives, replay_buckets)}

_RUNS = """runs AS (SELECT user_id AS qid, event_id AS ord, strftime(ts, '%Y-%m-%d') AS report, event_type <> 'error' AS passed, CASE WHEN event_type <> 'signup' THEN props END AS answer, event_type, event_type AS type,
  CASE WHEN (props->>'k')::INTEGER >= 10 THEN 'c' || substr(props->>'k', 1, 1) END AS category, value > 5 AS has_citation, value > 20 AS warned,
  CASE WHEN event_type <> 'view' THEN value > 15 END AS withheld, CASE WHEN event_type <> 'click' THEN value > 25 END AS whp FROM events)"""


def _wilson(passes: str = "passes", runs: str = "runs") -> str:
    p, z2, z = f"({passes}::DOUBLE / {runs})", "(1.96::DOUBLE * 1.96::DOUBLE)", "1.96::DOUBLE"
    mid = f"({p} + {z2} / (2 * {runs})) / (1 + {z2} / {runs})"
    half = f"{z} * sqrt({p} * (1 - {p}) / {runs} + {z2} / (4 * {runs} * {runs})) / (1 + {z2} / {runs})"
    return f"floor(greatest({mid} - {half}, 0) * 1e6 + 0.5) / 1e6 AS low, floor(least({mid} + {half}, 1) * 1e6 + 0.5) / 1e6 AS high"


_SIDES_ROWS = f"""{_RUNS}, sided AS (SELECT *, CASE WHEN report < '2024-01-16' THEN 'base' ELSE 'candidate' END AS side FROM runs WHERE answer IS NOT NULL)"""
_SIDES = f"""{_RUNS}, sided AS (SELECT *, CASE WHEN report < '2024-01-16' THEN 'base' ELSE 'candidate' END AS side FROM runs WHERE answer IS NOT NULL),
c AS (SELECT qid, count(*) FILTER (side = 'base') AS base_runs, count(*) FILTER (side = 'candidate') AS candidate_runs, count(*) FILTER (side = 'base' AND passed) AS base_passes, count(*) FILTER (side = 'candidate' AND passed) AS candidate_passes FROM sided GROUP BY 1),
d AS (SELECT *, CASE WHEN base_runs > 0 AND candidate_runs > 0 THEN 'both' WHEN base_runs > 0 THEN 'base_only' ELSE 'candidate_only' END AS presence, CASE WHEN base_runs > 0 AND candidate_runs > 0 THEN candidate_passes::DOUBLE / candidate_runs - base_passes::DOUBLE / base_runs END AS ch FROM c)"""
_REPORTS = """reports AS (SELECT c_name AS report, c_nationkey AS fingerprint FROM customer WHERE c_nationkey <> 0 AND c_acctbal >= 0 AND c_acctbal <= 9000 AND c_mktsegment NOT IN ('MACHINERY', 'BUILDING') AND (c_mktsegment = 'HOUSEHOLD' OR c_custkey % 7 <> 0))"""
_RECORDS = """records AS (SELECT event_id AS ord, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, user_id || '-' || strftime(ts, '%d') AS run_id, event_type AS kind, props->>'k' AS k FROM events)"""

ORACLES = {
    "wilson": f"WITH {_RUNS}, c AS (SELECT qid, count(*) AS runs, count(*) FILTER (passed) AS passes FROM runs WHERE answer IS NOT NULL GROUP BY 1) SELECT qid, runs, passes, {_wilson()} FROM c",
    "flakiness_classify": f"""WITH {_RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord DESC) AS back FROM runs WHERE answer IS NOT NULL QUALIFY back <= 20),
t AS (SELECT *, passed <> lag(passed) OVER (PARTITION BY qid ORDER BY ord) AS changed FROM b),
c AS (SELECT qid, count(*) AS runs, count(*) FILTER (passed) AS passes, count(*) FILTER (changed) AS transitions, coalesce(min(back) FILTER (passed) - 1, count(*)) AS fail_streak, coalesce(min(back) FILTER (NOT passed) - 1, count(*)) AS pass_streak FROM t GROUP BY 1)
SELECT *, CASE WHEN runs < 5 THEN 'insufficient' WHEN fail_streak >= 5 THEN 'regression' WHEN pass_streak >= 5 OR passes / runs >= 0.8 THEN 'solid' WHEN transitions >= 3 THEN 'flaky' WHEN passes / runs < 0.5 THEN 'regression' ELSE 'flaky' END AS class, {_wilson()} FROM c""",
    "infra_truncate": f"WITH {_RUNS}, f AS (SELECT *, min(CASE WHEN answer IS NULL THEN ord END) OVER (PARTITION BY report) AS first FROM runs) SELECT report, ord, qid FROM f WHERE first IS NULL OR ord < first",
    "infra_errors": f"WITH {_RUNS} SELECT qid, event_type AS error, count(*) AS n FROM runs WHERE answer IS NULL GROUP BY 1, 2",
    "ab_compare": f"""WITH {_SIDES} SELECT qid, base_runs, candidate_runs, base_passes, candidate_passes, presence, floor(ch * 1e6 + 0.5) / 1e6 AS change, coalesce(array_to_string(list_filter([
  CASE WHEN ch <= -0.5 + 1e-9 THEN 'REGRESSED' WHEN ch < -1e-9 THEN 'watch' WHEN ch > 1e-9 THEN 'improved' END, CASE WHEN presence = 'both' AND base_passes::DOUBLE / base_runs <= 1.0 / 3 + 1e-9 THEN 'low base' END,
  CASE WHEN presence = 'both' AND abs(ch) * least(base_runs, candidate_runs) <= 1 + 1e-9 AND abs(ch) > 1e-9 THEN 'within one pass' END], lambda x: x IS NOT NULL), ','), '') AS flags FROM d""",
    "ab_total": f"""WITH {_SIDES}, t AS (SELECT sum(candidate_runs)::BIGINT AS runs, floor(sum(-ch * candidate_runs) * 1e6 + 0.5) / 1e6 AS lost FROM d WHERE presence = 'both')
SELECT runs, lost, ((14 * runs + 99) // 100)::BIGINT AS threshold, runs >= 20 AND lost >= (14 * runs + 99) // 100 AS regressed FROM t""",
    "ab_consistency": f"""WITH {_SIDES}, l AS (SELECT side, unnest([{{'column': 'type', 'value': type}}, {{'column': 'category', 'value': coalesce(category, '(none)')}}, {{'column': 'has_citation', 'value': has_citation::VARCHAR}}], recursive := true) FROM sided),
s AS (SELECT "column", count(DISTINCT value) FILTER (side = 'base')::INTEGER AS n_base, count(DISTINCT value) FILTER (side = 'candidate')::INTEGER AS n_candidate, list_sort(list(DISTINCT value) FILTER (side = 'base')) <> list_sort(list(DISTINCT value) FILTER (side = 'candidate')) AS differs FROM l GROUP BY 1)
SELECT * FROM s WHERE n_base > 1 OR n_candidate > 1 OR differs""",
    "report_exclusion": f"WITH {_REPORTS} SELECT * FROM reports",
    "report_default_pair": f"""WITH {_REPORTS}, g AS (SELECT fingerprint, max(report) AS last FROM reports GROUP BY 1 ORDER BY last DESC LIMIT 2)
SELECT (SELECT fingerprint FROM g ORDER BY last LIMIT 1) AS base, (SELECT fingerprint FROM g ORDER BY last DESC LIMIT 1) AS candidate""",
    "grouping_breakdown": f"""WITH {_RUNS}, u AS (SELECT *, 'type' AS "by", type AS "group" FROM runs UNION ALL SELECT *, 'category', category FROM runs)
SELECT "by", "group", count(*) AS total, count(*) FILTER (answer IS NOT NULL AND passed) AS passed, count(*) FILTER (answer IS NOT NULL AND NOT has_citation) AS no_citation, count(*) FILTER (warned) AS unverified, count(*) FILTER (answer IS NULL) AS errors, min(ord) AS first_seen FROM u WHERE "group" IS NOT NULL GROUP BY 1, 2""",
    "gate_outcomes": f"""WITH {_RUNS}, l AS (SELECT CASE WHEN type = 'judged' THEN 'judged' WHEN withheld IS NULL THEN 'no_gate' WHEN withheld AND whp IS NULL THEN 'ungraded' WHEN withheld AND whp THEN 'fp' WHEN withheld THEN 'tp' WHEN NOT passed THEN 'fn' ELSE 'tn' END AS x FROM runs),
c AS (SELECT count(*) FILTER (x = 'judged') AS judged, count(*) FILTER (x = 'no_gate') AS no_gate, count(*) FILTER (x = 'ungraded') AS ungraded, count(*) FILTER (x = 'fp') AS false_positive, count(*) FILTER (x = 'tp') AS true_positive, count(*) FILTER (x = 'fn') AS false_negative, count(*) FILTER (x = 'tn') AS true_negative FROM l)
SELECT *, floor(false_positive::DOUBLE / nullif(false_positive + true_positive, 0) * 1e6 + 0.5) / 1e6 AS false_positive_rate FROM c""",
    "label_breakdown": "SELECT lang, source, count(*) AS n, sum(toxic)::BIGINT AS toxic, sum(quality)::BIGINT AS quality FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())",
    "ab_tally": f"WITH {_SIDES_ROWS} SELECT side, qid, count(*) AS runs, count(*) FILTER (passed) AS passes, count(*) FILTER (withheld) AS withheld FROM sided GROUP BY 1, 2",
    "gate_false_positives": f"""WITH {_RUNS}, e AS (SELECT ord, (props->>'k')::INTEGER AS k FROM runs JOIN events ON event_id = ord WHERE runs.event_type NOT IN ('click', 'error') AND warned AND whp)
SELECT c AS "check", count(*) AS n FROM (SELECT 'c' || k // 25 AS c FROM e UNION ALL SELECT CASE WHEN k % 2 = 1 THEN 'odd' ELSE 'even' END FROM e) GROUP BY 1""",
    "replay_buckets": """WITH o AS (SELECT o_orderkey % 17 = 0 AS e, o_orderkey % 7 = 0 AS drift, o_totalprice > 200000 AS was, o_totalprice > 250000 OR o_orderkey % 10 = 3 AS now, o_orderkey % 3 > 0 AND o_orderkey % 3 <> o_orderkey % 2 + 1 AS other, CASE o_orderstatus WHEN 'P' THEN 'ungraded' WHEN 'F' THEN 'correct' ELSE 'wrong' END AS g FROM orders)
SELECT CASE WHEN e THEN 'errored' WHEN was = now AND NOT (was AND other) THEN 'same' WHEN drift THEN 'drifted_change' WHEN was AND NOT now THEN 'recovered_' || g WHEN now AND NOT was THEN 'newly_refused_' || g ELSE 'check_change' END AS bucket, count(*) AS runs, count(*) FILTER (drift) AS drifted FROM o GROUP BY 1""",
    "trace_counts": f"WITH {_RECORDS} SELECT kind, k, count(*) AS n, min(ord) AS first_seen FROM records GROUP BY 1, 2",
    "trace_filter": f"WITH {_RECORDS} SELECT ord, timestamp, run_id, kind FROM records WHERE timestamp >= '2024-01-05' AND timestamp < '2024-01-20T12' AND kind IN ('error', 'purchase')",
    "run_timeline": f"WITH {_RECORDS} SELECT run_id, min(timestamp) AS first, count(*) AS n, string_agg(kind, ' > ' ORDER BY timestamp, ord) AS steps FROM records GROUP BY 1",
    "run_final_step": """WITH a AS (SELECT conv_id, text AS answer FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
SELECT conv_id AS run_id, turn AS ord, role FROM conversations JOIN a USING (conv_id) WHERE text = answer QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "run_questions": """WITH roots AS (SELECT conv_id, text FROM conversations WHERE turn = 0), f AS (SELECT text, min(conv_id) AS id FROM roots GROUP BY 1),
k AS (SELECT trim(text) AS t, id FROM f QUALIFY row_number() OVER (PARTITION BY trim(text) ORDER BY id DESC) = 1)
SELECT conv_id AS run_id, coalesce(id::VARCHAR, '?') AS qid FROM roots LEFT JOIN k ON trim(text) = t""",
    "replay_outcomes": """WITH o AS (SELECT o_orderkey AS r, o_totalprice > 200000 AS was, o_totalprice > 250000 OR o_orderkey % 10 = 3 AS now, CASE WHEN o_orderstatus = 'P' THEN 'ungraded' WHEN o_orderstatus = 'F' THEN 'correct' ELSE 'wrong' END AS g, o_orderpriority <> '5-LOW' AS b, o_orderpriority <> '3-MEDIUM' AS n FROM orders)
SELECT CASE WHEN NOT b THEN 'only_in_replay' WHEN NOT n THEN 'only_in_base' ELSE 'both' END AS presence, CASE WHEN b AND n AND was AND NOT now THEN 'recovered_' || g WHEN b AND n AND NOT was AND now THEN 'newly_refused_' || g WHEN b AND n THEN 'same' END AS change, count(*) AS n FROM o WHERE b OR n GROUP BY 1, 2""",
}
