"""Structured facts: validation, picking one of several reported values, comparison over entities.

A fact table has the columns entity, metric, tag, unit, ord, start, end, val, accn, fy, fp, form, filed and frame. Values are
re-reported, so each picker ranks the candidates of a key by explicit keys that end with ``ord``, the order of reporting:
results never depend on partitioning. Ranking is a window over a key's own candidates (one entity and metric), which is
small; nothing ranks the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.fiscal import duration_days, is_canonical_date

#: Days of a quarter and of a year.
QUARTER_DAYS = (80, 100)
ANNUAL_DAYS = (350, 380)
#: Metrics with their default tags and kind.
METRICS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "duration"),
    "gross_profit": ("GrossProfit", "duration"),
    "cost_of_revenue": ("CostOfRevenue", "duration"),
    "rd_expense": ("ResearchAndDevelopmentExpense", "duration"),
    "net_income": ("NetIncomeLoss", "duration"),
    "operating_income": ("OperatingIncomeLoss", "duration"),
    "total_assets": ("Assets", "instant"),
    "cash_and_equivalents": ("CashAndCashEquivalentsAtCarryingValue", "instant"),
    "inventory": ("InventoryNet", "instant"),
}


def entry_defect(raw: DataFrame) -> Column:
    """First failing check of a raw entry (string columns end, start, fy, filed; double val; has_start), or null."""
    finite = F.col("val").isNotNull() & ~F.isnan("val") & (F.abs("val") < float("inf"))
    return (
        F.when(~is_canonical_date(F.col("end")), "bad_end")
        .when(F.col("has_start") & ~is_canonical_date(F.col("start")), "bad_start")
        .when(~finite, "bad_val")
        .when(F.col("accn").isNull() | (F.col("accn") == ""), "bad_accn")
        .when(F.col("form").isNull() | (F.col("form") == ""), "bad_form")
        .when(F.col("filed").isNotNull() & ~is_canonical_date(F.col("filed")), "bad_filed")
        .when(F.col("fy").isNotNull() & F.expr("try_cast(fy AS INT)").isNull(), "bad_fy")
    )


def split_defects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable entries, counts of rejected entries by reason)."""
    marked = raw.withColumn("defect", entry_defect(raw))
    return marked.where("defect is null").drop("defect"), marked.where("defect is not null").groupBy("defect").agg(F.count("*").alias("n"))


def duration_bucket(duration: Column) -> Column:
    """1 quarter, 2 year, 3 instant, null for other durations (year to date)."""
    return F.when(duration.between(*QUARTER_DAYS), 1).when(duration.between(*ANNUAL_DAYS), 2).when(duration.isNull(), 3)


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def _filed() -> Column:
    return F.coalesce(F.col("filed").cast("string"), F.lit("")).desc()


def pick_period(facts: DataFrame, keys: tuple[str, ...] = ("entity", "metric", "fy", "fp")) -> DataFrame:
    """The value of a fiscal period: an annual report's year or a quarter's own quarter, the latest end, then the latest filed."""
    duration = duration_days(F.col("start"), F.col("end"))
    fits = F.when(F.col("fp") == "FY", (F.col("form") == "10-K") & (duration.isNull() | duration.between(*ANNUAL_DAYS))).otherwise(duration.isNull() | duration.between(*QUARTER_DAYS))
    return _first(facts.where(fits), list(keys), [F.col("end").desc(), _filed(), F.col("ord").asc()])


def pick_end_date(facts: DataFrame, keys: tuple[str, ...] = ("entity", "metric", "end")) -> DataFrame:
    """The value at an end date: a quarter before a year before an instant, then the latest filed."""
    bucketed = facts.withColumn("bucket", duration_bucket(duration_days(F.col("start"), F.col("end")))).where("bucket is not null")
    return _first(bucketed, list(keys), [F.col("bucket").asc(), _filed(), F.col("ord").asc()])


def pick_latest(facts: DataFrame, keys: tuple[str, ...] = ("entity", "metric")) -> DataFrame:
    """The latest value: the latest end, the shorter duration, the latest filed."""
    duration = F.coalesce(duration_days(F.col("start"), F.col("end")), F.lit(0))
    return _first(facts, list(keys), [F.col("end").desc(), duration.asc(), _filed(), F.col("ord").asc()])


def get_metric(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers to requests (request_id, entity, metric, fy, fp, period_end): by end date if one is given, the latest if no
    year is given, else by fiscal year and period. A request without an answer has no row."""
    by_end = requests.where("coalesce(period_end, '') <> ''").withColumn("end", F.expr("try_cast(period_end AS DATE)"))
    latest = requests.where("coalesce(period_end, '') = '' and fy is null")
    by_period = requests.where("coalesce(period_end, '') = '' and fy is not null")
    wanted = ["request_id", "entity", "metric", "val", "unit", "end", "form", "accn", "filed", "frame", "fy", "fp"]
    parts = [
        pick_end_date(facts).join(by_end.select("request_id", "entity", "metric", "end"), ["entity", "metric", "end"]),
        pick_latest(facts).join(latest.select("request_id", "entity", "metric"), ["entity", "metric"]),
        pick_period(facts).join(by_period.select("request_id", "entity", "metric", "fy", "fp"), ["entity", "metric", "fy", "fp"]),
    ]
    return parts[0].select(wanted).unionByName(parts[1].select(wanted)).unionByName(parts[2].select(wanted))


def is_tagged(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests whose entity has ever reported the metric."""
    return requests.join(facts.select("entity", "metric").distinct(), ["entity", "metric"], "left_semi")


def tag_of(requests: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Requests with their ``tag``: the entity's own, else the metric's default. Both dimensions are small by their nature."""
    own = overrides.select("entity", "metric", F.col("tag").alias("own_tag"))
    return requests.join(own, ["entity", "metric"], "left").join(defaults.select("metric", F.col("tag").alias("default_tag")), "metric", "left").withColumn("tag", F.coalesce("own_tag", "default_tag")).drop("own_tag", "default_tag")


def merge_frame(frame_rows: DataFrame, keys: tuple[str, ...] = ("entity", "frame")) -> DataFrame:
    """One row per entity of a frame: the designated tag, else the alphabetically first; ``conflict``: tags disagree."""
    window = Window.partitionBy(*keys)
    ranked = frame_rows.withColumn("_rank", F.row_number().over(window.orderBy((F.col("tag") == F.col("designated")).desc(), F.col("tag"), F.col("ord"))))
    ranked = ranked.withColumn("conflict", F.min("tag").over(window) != F.max("tag").over(window))
    return ranked.where("_rank = 1").drop("_rank")


def metric_all_entities(facts: DataFrame, anchor: str, metric: str, fy: int, fp: str) -> DataFrame:
    """All entities' values of a metric for the anchor's period.

    An amount at a date is each entity's own value of the fiscal period. An amount over a period is looked up by the frame
    in which the anchor entity reports it; without an anchor value or frame there is no result.
    """
    if METRICS.get(metric, ("", "duration"))[1] == "instant":
        return pick_period(facts.where((F.col("metric") == metric) & (F.col("fy") == fy) & (F.col("fp") == fp)))
    frame = pick_period(facts.where((F.col("entity") == anchor) & (F.col("metric") == metric) & (F.col("fy") == fy) & (F.col("fp") == fp))).where("frame is not null").select("frame")
    rows = facts.where(F.col("metric") == metric).join(F.broadcast(frame), "frame")  # at most one row
    designated = rows.withColumn("designated", F.lit(METRICS.get(metric, ("",))[0]))
    return merge_frame(designated).drop("designated", "conflict")
