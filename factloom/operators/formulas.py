"""Ratios, growth and averages over resolved facts, driven by a registry table instead of one plan per formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numeric import growth, ratio, rounded

#: Name, numerator, denominator, as a percentage, comparable across companies.
RATIOS = (
    ("gross_margin", "gross_profit", "revenue", True, True),
    ("operating_margin", "operating_income", "revenue", True, True),
    ("net_margin", "net_income", "revenue", True, True),
    ("return_on_assets", "net_income", "total_assets", True, False),
    ("asset_turnover", "revenue", "total_assets", False, False),
    ("cash_to_assets", "cash_and_equivalents", "total_assets", True, False),
    ("inventory_turnover", "cost_of_revenue", "inventory", False, False),
    ("rd_intensity", "rd_expense", "revenue", True, False),
)


def registry(spark: SparkSession, rows: tuple = RATIOS) -> DataFrame:
    return spark.createDataFrame(list(rows), "ratio string, numerator string, denominator string, as_percent boolean, cross_company boolean")


def ratios(resolved: DataFrame, definitions: DataFrame, keys: tuple[str, ...] = ("entity", "fy", "fp")) -> DataFrame:
    """Every registered ratio of every key from resolved facts (keys, metric, value, end): legs must end on the same day and
    the denominator must not be zero. ``raw`` is the value before rounding. One join for all ratios; the registry has a row per ratio and is broadcast."""
    legs = list(keys)
    top = resolved.join(F.broadcast(definitions), F.col("metric") == F.col("numerator")).select(*legs, "ratio", "as_percent", "denominator", F.col("value").alias("a"), "end")
    bottom = resolved.select(*legs, F.col("metric").alias("denominator"), F.col("value").alias("b"), F.col("end").alias("b_end"))
    return top.join(bottom, [*legs, "denominator"]).where("end = b_end and b <> 0").select(
        *legs, "ratio", "end", ratio(F.col("a"), F.col("b"), F.col("as_percent")).alias("value"),
        (F.col("a") / F.col("b") * F.when(F.col("as_percent"), 100.0).otherwise(1.0)).alias("raw"), F.when(F.col("as_percent"), "percent").otherwise("ratio").alias("unit"),
    )


def ratios_across(frames: DataFrame, definitions: DataFrame) -> DataFrame:
    """Ratios of all entities of a frame (entity, metric, value, end), for the ratios that may be compared."""
    return ratios(frames, definitions.where("cross_company"), ("entity",))


def yoy_growth(resolved: DataFrame, keys: tuple[str, ...] = ("entity", "metric", "fp")) -> DataFrame:
    """Growth against the same period of the year before. A join on fy - 1, not a lag: years may be missing."""
    prior = resolved.select(*keys, (F.col("fy") + 1).alias("fy"), F.col("value").alias("prior"))
    return resolved.join(prior, [*keys, "fy"]).where("prior <> 0").select(*keys, "fy", growth(F.col("value"), F.col("prior")).alias("growth"))


def multi_year_average(resolved: DataFrame, requests: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Mean over every year of requests (request_id, entity, metric, first_year, last_year); no row if a year is missing or
    the range has fewer than two years. A mean of percents has one decimal, others are not rounded; ``unit`` (if there
    is one) and the columns ``kept`` are those of the last year."""
    years = requests.where("last_year > first_year").select("request_id", "entity", "metric", "first_year", "last_year", F.explode(F.sequence("first_year", "last_year")).alias("fy"))
    named = [c for c in ("unit", *kept) if c in resolved.columns]
    found = years.join(resolved.select("entity", "metric", "fy", "value", *named), ["entity", "metric", "fy"])
    last = [F.max_by(c, "fy").alias(c) for c in named]
    mean = found.groupBy("request_id", "entity", "metric").agg(F.count("value").alias("n"), F.min(F.col("last_year") - F.col("first_year") + 1).alias("needed"), F.avg("value").alias("mean"), *last)
    shown = F.when(F.col("unit") == "percent", rounded(F.col("mean"), 1)).otherwise(F.col("mean")) if "unit" in named else F.col("mean")
    return mean.where("n = needed").select("request_id", "entity", "metric", "n", shown.alias("mean"), *named)
