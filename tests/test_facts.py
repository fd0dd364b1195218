import datetime as dt

from pyspark.sql import functions as F

from factloom.operators import facts, formulas

D = dt.date
SCHEMA = "entity string, metric string, tag string, unit string, ord long, start date, end date, val double, accn string, fy int, fp string, form string, filed date, frame string"


def fact(ord, start, end, val, fy, fp, form, filed=None, frame=None, metric="revenue", entity="A", tag="R"):
    return (entity, metric, tag, "USD", ord, start, end, float(val), f"a{ord}", fy, fp, form, filed, frame)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_one_filing_restates_three_years(spark):
    df = rows(spark, *[fact(i, D(2021 + i, 1, 1), D(2021 + i, 12, 31), 100 + i, 2023, "FY", "10-K") for i in range(3)])
    assert [(r.end, r.val) for r in facts.pick_period(df).collect()] == [(D(2023, 12, 31), 102.0)]


def test_quarter_wins_over_year_to_date(spark):
    df = rows(
        spark,
        fact(0, D(2024, 1, 1), D(2024, 9, 30), 300, 2024, "Q3", "10-Q"), fact(1, D(2024, 7, 1), D(2024, 9, 30), 110, 2024, "Q3", "10-Q"),
        fact(2, D(2023, 1, 1), D(2023, 9, 30), 250, 2024, "Q3", "10-Q"), fact(3, D(2023, 7, 1), D(2023, 9, 30), 90, 2024, "Q3", "10-Q"),
    )
    assert [r.val for r in facts.pick_period(df).collect()] == [110.0]
    assert {r.end: r.val for r in facts.pick_end_date(df).collect()} == {D(2024, 9, 30): 110.0, D(2023, 9, 30): 90.0}


def test_latest_prefers_shorter_duration_then_filed_then_first(spark):
    df = rows(
        spark,
        fact(0, D(2024, 1, 1), D(2024, 9, 30), 300, 2024, "Q3", "10-Q", D(2024, 11, 1)), fact(1, D(2024, 7, 1), D(2024, 9, 30), 110, 2024, "Q3", "10-Q"),
        fact(2, D(2024, 7, 1), D(2024, 9, 30), 111, 2024, "Q3", "10-Q", D(2024, 11, 1)), fact(3, D(2024, 7, 1), D(2024, 9, 30), 112, 2024, "Q3", "10-Q", D(2024, 11, 1)),
    )
    for parts in (1, 4):
        assert [r.val for r in facts.pick_latest(df.repartition(parts)).collect()] == [111.0]


def test_request_modes_and_instants(spark):
    df = rows(spark, fact(0, None, D(2024, 6, 30), 7, 2024, "Q2", "10-Q", metric="total_assets"), fact(1, None, D(2023, 12, 31), 5, 2023, "FY", "10-K", metric="total_assets"))
    requests = spark.createDataFrame([("r1", "A", "total_assets", None, None, "2023-12-31"), ("r2", "A", "total_assets", None, None, ""), ("r3", "A", "total_assets", 2024, "Q2", None), ("r4", "B", "total_assets", None, None, None)], "request_id string, entity string, metric string, fy int, fp string, period_end string")
    assert {r.request_id: r.val for r in facts.get_metric(df, requests).collect()} == {"r1": 5.0, "r2": 7.0, "r3": 7.0}
    assert facts.is_tagged(df, requests).count() == 3


def test_designated_tag_then_alphabet(spark):
    df = rows(spark, fact(0, None, D(2024, 6, 30), 1, 2024, "Q2", "10-Q", frame="f", tag="B"), fact(1, None, D(2024, 6, 30), 2, 2024, "Q2", "10-Q", frame="f", tag="Z"), fact(2, None, D(2024, 6, 30), 3, 2024, "Q2", "10-Q", frame="f", tag="A", entity="C"), fact(3, None, D(2024, 6, 30), 4, 2024, "Q2", "10-Q", frame="f", tag="B", entity="C"))
    got = {r.entity: (r.tag, r.conflict) for r in facts.merge_frame(df.withColumn("designated", F.lit("Z"))).collect()}
    assert got == {"A": ("Z", True), "C": ("A", True)}


def test_defects_in_order(spark):
    raw = spark.createDataFrame(
        [("2024-02-30", None, False, 1.0, "a", "10-K", None, "2024"), ("2024-02-28", "x", True, 1.0, "a", "10-K", None, "2024"), ("2024-02-28", None, True, 1.0, "a", "10-K", None, None),
         ("2024-02-28", None, False, float("nan"), "a", "10-K", None, None), ("2024-02-28", None, False, 1.0, "", "", None, None), ("2024-02-28", None, False, 1.0, "a", "10-K", None, None)],
        "end string, start string, has_start boolean, val double, accn string, form string, filed string, fy string",
    )
    good, bad = facts.split_defects(raw)
    assert good.count() == 1 and {r.defect: r.n for r in bad.collect()} == {"bad_end": 1, "bad_start": 2, "bad_val": 1, "bad_accn": 1}


def resolved(spark, *values):
    return spark.createDataFrame(list(values), "entity string, fy int, fp string, metric string, value double, end date")


def test_ratios(spark):
    e = D(2024, 12, 31)
    df = resolved(spark, ("A", 2024, "FY", "gross_profit", 46.0, e), ("A", 2024, "FY", "revenue", 100.0, e), ("B", 2024, "FY", "gross_profit", 1.0, e), ("B", 2024, "FY", "revenue", 0.0, e), ("C", 2024, "FY", "gross_profit", 1.0, e), ("C", 2024, "FY", "revenue", 2.0, D(2024, 9, 30)))
    got = {(r.entity, r.ratio): r.value for r in formulas.ratios(df, formulas.registry(spark)).collect()}
    assert got == {("A", "gross_margin"): 46.0}


def test_growth_skips_gaps_and_zero(spark):
    df = resolved(spark, *[("A", y, "FY", "revenue", v, None) for y, v in ((2020, 100.0), (2021, 150.0), (2023, 200.0))], *[("B", y, "FY", "revenue", v, None) for y, v in ((2020, 0.0), (2021, 5.0), (2022, 4.0))])
    assert {(r.entity, r.fy): r.growth for r in formulas.yoy_growth(df).collect()} == {("A", 2021): 50.0, ("B", 2022): -20.0}


def test_average_needs_every_year(spark):
    df = resolved(spark, *[("A", y, "FY", "revenue", float(y - 2000), None) for y in (2020, 2021, 2022, 2024)])
    asked = spark.createDataFrame([("ok", "A", "revenue", 2020, 2022), ("gap", "A", "revenue", 2021, 2024), ("short", "A", "revenue", 2021, 2021)], "request_id string, entity string, metric string, first_year int, last_year int")
    assert [(r.request_id, r.mean) for r in formulas.multi_year_average(df, asked).collect()] == [("ok", 21.0)]


def test_comparison_by_frame_or_by_own_period(spark):
    e = D(2024, 12, 31)
    df = rows(
        spark,
        fact(0, D(2024, 1, 1), e, 10, 2024, "FY", "10-K", frame="CY2024"), fact(1, D(2024, 2, 1), D(2025, 1, 31), 20, 2025, "FY", "10-K", frame="CY2024", entity="B"), fact(2, D(2024, 1, 1), e, 5, 2024, "FY", "10-K", entity="C"),
        fact(3, None, e, 7, 2024, "FY", "10-K", metric="total_assets"), fact(4, None, D(2024, 6, 30), 8, 2024, "FY", "10-K", metric="total_assets", entity="B"),
    )
    assert {r.entity: r.val for r in facts.metric_all_entities(df, "A", "revenue", 2024, "FY").collect()} == {"A": 10.0, "B": 20.0}
    assert facts.metric_all_entities(df, "C", "revenue", 2024, "FY").count() == 0
    assert {r.entity: r.val for r in facts.metric_all_entities(df, "A", "total_assets", 2024, "FY").collect()} == {"A": 7.0, "B": 8.0}


def test_requests_join_lines_and_orders_once(spark, sf_dir):
    from factloom.plans.fact_queries import fact_requests

    assert not any("lineitem" in f or "orders" in f for f in fact_requests(spark, sf_dir).inputFiles())
