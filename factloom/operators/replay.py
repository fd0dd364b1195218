"""Logged tool calls made again: each call goes to the operator of its tool, all in one plan, and what comes out is compared.

Calls are routed by tool to facts, calculations, comparisons across entities and searches. Each route is one batch plan over all
its calls; equal searches run once. Arguments that can't be read give an error instead of an output, for that call alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numeric import calculate
from factloom.operators import formulas, requests
from factloom.operators.reports import OBSERVED, observed_differences
from factloom.sources.shared import written


def _get(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("args", f"$.{name}", kind)


def _output(**fields: Column) -> Column:
    """The fields that a tool logs, as a variant; null ones are absent."""
    return F.try_parse_json(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))))


def replayed(calls: DataFrame, resolved: DataFrame, ratios: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """calls (run_id, ord, tool, args, logged) with ``replayed`` and ``error``; args and outputs are variants.

    resolved (entity, metric, fy, fp, value, end) are the facts, ratios the registry; ``search`` turns distinct searches (query, ticker)
    into (query, ticker, result_count). A tool without a route and unreadable arguments have an error and no output.
    """
    readable = F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False))
    error = F.when(~F.col("tool").isin(*OBSERVED), F.concat(F.lit("no replay route for tool "), F.col("tool"))).when(~readable, "arguments are no object")
    resolved = written(resolved, "resolved")  # every route reads it, some of them several times
    called = written(calls.withColumn("error", error).withColumn("call_id", F.monotonically_increasing_id()), "calls")
    fine = called.where("error is null")

    asked = fine.where("tool = 'get_financial_fact'").select(
        F.col("call_id").alias("request_id"), _get("ticker").alias("entity"), _get("metric").alias("metric"), requests.coerce_year(_get("fiscal_year")).alias("fy"), F.coalesce(_get("fiscal_period"), F.lit("FY")).alias("fp"),
        requests.coerce_year(_get("start_year")).alias("first_year"), requests.coerce_year(_get("end_year")).alias("last_year"), F.coalesce(_get("growth", "boolean"), F.lit(False)).alias("growth"),
    )
    answers, unmet = requests.answer(asked, resolved, ratios)
    facts = answers.select(F.col("request_id").alias("call_id"), _output(found=F.lit(True), value=F.col("value")).alias("replayed"))
    facts = facts.unionByName(unmet.select(F.col("request_id").alias("call_id"), _output(found=F.lit(False)).alias("replayed")))

    number = lambda name: _get(name, "double")
    unit = lambda name: F.coalesce(_get(name), F.lit("raw"))
    result = calculate(_get("operation"), number("operand_a"), unit("unit_a"), number("operand_b"), unit("unit_b"))["value"]
    calculated = fine.where("tool = 'calculate'").select("call_id", _output(found=result.isNotNull(), value=result).alias("replayed"))

    compared = fine.where("tool = 'compare_financial_metric'").select("call_id", _get("metric").alias("metric"), requests.coerce_year(_get("fiscal_year")).alias("fy"), F.coalesce(_get("fiscal_period"), F.lit("FY")).alias("fp"))
    across = ratios.where("cross_company").select("ratio")
    values = resolved.select("entity", "metric", "fy", "fp").unionByName(formulas.ratios(resolved, ratios).join(across, "ratio").select("entity", F.col("ratio").alias("metric"), "fy", "fp"))
    companies = compared.select("metric", "fy", "fp").distinct().join(values, ["metric", "fy", "fp"]).groupBy("metric", "fy", "fp").agg(F.array_sort(F.collect_set("entity")).alias("companies"))
    companies = compared.join(companies, ["metric", "fy", "fp"], "left").select("call_id", _output(found=F.col("companies").isNotNull(), companies=F.col("companies")).alias("replayed"))

    searched = fine.where("tool = 'search_filings'").select("call_id", F.coalesce(_get("query"), F.lit("")).alias("query"), _get("ticker").alias("ticker"))
    counts = search(searched.select("query", "ticker").distinct()).select(F.col("query").alias("_query"), F.col("ticker").alias("_ticker"), "result_count")
    same = (F.col("query") == F.col("_query")) & F.col("ticker").eqNullSafe(F.col("_ticker"))
    found = searched.join(counts, same, "left").select("call_id", _output(result_count=F.coalesce("result_count", F.lit(0))).alias("replayed"))

    outputs = facts.unionByName(calculated).unionByName(companies).unionByName(found)
    return called.join(outputs, "call_id", "left").drop("call_id")


def replay_differences(replay: DataFrame) -> DataFrame:
    """(run_id, ord, tool, field, logged, replayed): the fields that came out otherwise, and each error as a field of its own."""
    wrong = replay.where("error is not null").select("run_id", "ord", "tool", F.lit("error").alias("field"), F.lit(None).cast("string").alias("logged"), F.col("error").alias("replayed"))
    return observed_differences(replay.where("error is null").select("run_id", "ord", "tool", "logged", "replayed")).unionByName(wrong)


def run_outcomes(replay: DataFrame) -> DataFrame:
    """(run_id, calls, error, drift): a run ends at its first error, and drifts if a call before it came out otherwise."""
    replay = written(replay.select("run_id", "ord", "tool", "error", "logged", "replayed"), "replay")  # read twice, made again once
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("ord", "error"))).alias("_first")
    ends = replay.groupBy("run_id").agg(first, F.count("*").alias("calls"))
    drift = replay_differences(replay).where("field <> 'error'").groupBy("run_id", "ord").agg(F.count("*").alias("_n")).join(ends, "run_id")
    drift = drift.where("_first is null or ord < _first.ord").groupBy("run_id").agg(F.count("*").alias("drift"))
    return ends.join(drift, "run_id", "left").select("run_id", "calls", F.col("_first.error").alias("error"), F.coalesce("drift", F.lit(0)).alias("drift"))
