import datetime as dt
import math

from pyspark.sql import functions as F

from factloom.operators import bm25, fusion, retrieval, scope
from factloom.operators.windows import split_windows


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string, part string")


def test_partition_statistics_do_not_mix(spark):
    q = spark.createDataFrame([("q", "apple banana")], "query_id string, query string")
    alone = docs(spark, (1, "apple pie apple", "x"), (2, "banana split", "x"), (3, "cherry", "x"), (9, None, "x"))
    more = alone.unionByName(docs(spark, *[(100 + i, "apple " * i, "y") for i in range(1, 20)]))
    score = lambda df: {r.doc_id: r.score for r in bm25.bm25_by_partition(df, q, "part").where("part = 'x'").collect()}
    assert score(alone) == score(more) and set(score(alone)) == {1, 2}


def test_the_mean_idf_does_not_drift(spark):
    q = spark.createDataFrame([("q", "the")], "query_id string, query string")
    rows = [(i, "the " + " ".join(f"w{i}x{k}" for k in range(1000)), "x") for i in range(30)]
    got = {r.score for r in bm25.bm25_global(docs(spark, *rows).repartition(3), q).collect()}
    rare, common = math.log((30 - 1 + 0.5) / 1.5), math.log(0.5 / 30.5)
    mean = (30_000 * rare + common) / 30_001
    assert len(got) == 1 and abs(got.pop() / (mean * bm25.NEGATIVE_SHARE) - 1) < 1e-15


def test_cutoff_and_ties(spark):
    scored = spark.createDataFrame([("q", 2, 1.0), ("q", 1, 1.0), ("q", 3, 0.0), ("q", 4, 2.0)], "query_id string, doc_id long, score double")
    assert [(r.rank, r.doc_id) for r in bm25.top_n(scored.repartition(3), 2, ["query_id"]).orderBy("rank").collect()] == [(1, 4), (2, 1)]
    assert bm25.top_n(scored, 9, ["query_id"]).count() == 3


def ranked(spark, *ids):
    return spark.createDataFrame([("q", d, i) for i, d in enumerate(ids, 1)], "query_id string, doc_id long, rank int")


def test_rrf_order_and_ties(spark):
    out = fusion.reciprocal_rank_fusion(ranked(spark, 1, 2, 3), ranked(spark, 4, 2, 1)).orderBy("fused_rank").collect()
    assert [r.doc_id for r in out] == [1, 2, 4, 3] or [r.doc_id for r in out] == [2, 1, 4, 3]
    tie = fusion.reciprocal_rank_fusion(ranked(spark, 7), ranked(spark, 5)).orderBy("fused_rank").collect()
    assert [r.doc_id for r in tie] == [7, 5]


def pool(spark, rows):
    return spark.createDataFrame([("q", d, i, float(ce), t, r) for i, (d, ce, t, r) in enumerate(rows, 1)], "query_id string, doc_id long, fused_rank int, ce_score double, contains_table boolean, rescuable boolean")


def test_floor_keeps_the_fused_top(spark):
    out = fusion.combine(pool(spark, [(1, 0, False, False), (2, 9, False, False), (3, 8, False, False), (4, 7, False, False), (5, 6, False, False), (6, 5, False, False)])).orderBy("combined_rank").collect()
    assert out[0].doc_id == 2 and out[1].doc_id == 1


def test_rescue_swaps_the_last_place_only_without_a_table(spark):
    rows = [(i, 20 - i, False, False) for i in range(1, 13)]
    rows[5] = (6, -1, True, True)
    got = {r.final_rank: (r.doc_id, r.rescued) for r in fusion.rescue(fusion.combine(pool(spark, rows))).collect()}
    assert got[5] == (6, True) and len(got) == 5
    rows[0] = (1, 19, True, False)
    assert not any(r.rescued for r in fusion.rescue(fusion.combine(pool(spark, rows))).collect())
    rows[0] = (1, 19, False, False)
    rows[5], rows[10] = (6, 14, False, False), (11, -1, True, True)
    assert not any(r.rescued for r in fusion.rescue(fusion.combine(pool(spark, rows))).collect())


def test_choose_lists_falls_back(spark):
    rows = [("a", "bm25", 1, 0.5, True), ("a", "bm25", 9, 0.9, False), ("a", "vector", 9, 0.9, False), ("b", "bm25", 8, 0.9, False), ("c", "vector", 7, 0.9, False), ("c", "vector", 6, 1.0, False)]
    candidates = spark.createDataFrame(rows, "query_id string, retriever string, doc_id long, score double, in_scope boolean")
    scopes = spark.createDataFrame([("a", "dates"), ("b", "dates"), ("c", "no_date")], "query_id string, reason string")
    out = {(r.query_id, r.doc_id, r.rank, r.label) for r in fusion.choose_lists(candidates.join(scopes, "query_id")).collect()}
    assert out == {("a", 1, 1, "dates"), ("b", 8, 1, "filtered_empty"), ("c", 6, 1, "no_date"), ("c", 7, 2, "no_date")}


def test_scopes(spark):
    filings = spark.createDataFrame([("N", "10-Q", dt.date(2026, 4, 26), 0), ("N", "10-K", dt.date(2026, 1, 25), 1), ("A", "10-Q", dt.date(2026, 3, 28), 2)], "ticker string, form string, report_date date, first_seen long")
    calendars = spark.createDataFrame([("N", 1), ("A", 9)], "ticker string, end_month int")
    asked = spark.createDataFrame([("1", "N", "as of April 30, 2026"), ("2", "N", "fiscal year 2026 revenue"), ("3", "N", "Q1 FY27"), ("4", "N", "September 31, 2025"), ("5", None, "second fiscal quarter of fiscal 2026")], "query_id string, ticker string, query string")
    got = {r.query_id: ([str(d) for d in r.report_dates], r.reason, r.n_invalid) for r in scope.query_scopes(asked, filings, calendars).collect()}
    assert got == {"1": (["2026-04-26"], "dates", 0), "2": (["2026-01-25"], "dates", 0), "3": (["2026-04-26"], "dates", 0), "4": ([], "no_date", 1), "5": (["2026-03-28"], "dates", 0)}


def test_windows_repeat_the_table_head():
    text = "\n".join(["Caption", "<TABLE>", "| h |", "| --- |", "| r0 |", *[f"| row {i} x y |" for i in range(6)], "</TABLE>", "after"])
    out = split_windows(text, 30)
    assert len(out) > 1 and out[1].split("\n")[:2] == ["Caption", "<TABLE>"]
    assert split_windows("one line far too long " * 5, 3) == ["one line far too long " * 5]


CHUNKS = "doc_id long, ticker string, form string, report_date date, text string, embedding array<double>, contains_table boolean"
SEARCHES = "query_id string, ticker string, query string, q array<double>"


def test_hybrid_search(spark):
    day = lambda i: dt.date(2025 + i % 2, 6, 30)
    rows = [(i, t, "10-K", day(i), f"topic {w} text", [float(i % 4 == j) for j in range(4)], False) for i, (t, w) in enumerate((t, w) for t in "AB" for w in ("alpha", "beta", "gamma", "delta"))]
    chunks, calendars = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([("A", 6), ("B", 6)], "ticker string, end_month int")
    asked = [("own", "A", "beta topic"), ("all", None, "beta topic"), ("dated", "B", "topic as of June 30, 2026"), ("none", "C", "beta topic")]
    queries = spark.createDataFrame([(*q, [0.0, 1.0, 0.0, 0.0]) for q in asked], SEARCHES)
    got = {}
    for r in retrieval.hybrid_search(chunks, queries, calendars).orderBy("final_rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.label))
    assert got["own"][0] == (1, "no_date") and {d for d, _ in got["own"]} == {0, 1, 2, 3}
    assert {d for d, _ in got["all"][:2]} == {1, 5} and len(got["all"]) == 5
    assert {d for d, _ in got["dated"]} == {5, 7} and got["dated"][0][1] == "dates"
    assert "none" not in got  # no filing of that ticker


def test_own_part_is_an_index_of_its_own(spark):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["apple pie", "pear", "fig", "plum", "nut"])] + [(100 + i, "apple", "y") for i in range(5)], "doc_id long, text string, part string")
    q = spark.createDataFrame([("q", "apple", "x"), ("r", "apple", "y")], "query_id string, query string, part string")
    got = {(r.query_id, r.doc_id): r.score for r in bm25.bm25_own_part(d, q, "part").collect()}
    alone = {r.doc_id: r.score for r in bm25.bm25_global(d.where("part = 'x'"), q.where("query_id = 'q'")).collect()}
    assert {k: v for k, v in got.items() if k[0] == "q"} == {("q", k): v for k, v in alone.items()} and len(got) == 6


def test_no_query_terms(spark):
    assert bm25.bm25_global(docs(spark, (1, "a", "x")), spark.createDataFrame([("q", "zzz")], "query_id string, query string")).count() == 0
    assert F.col("x") is not None


def test_a_part_is_not_gathered_in_one_task(spark):
    """Documents meet the parts that queries name without being shuffled by part."""
    from factloom.operators import bm25

    docs = spark.createDataFrame([(1, "a", "red fox"), (2, "b", "red hen"), (3, "a", "blue hen")], "doc_id int, ticker string, text string")
    asked = spark.createDataFrame([("q", "fox", "a")], "query_id string, query string, ticker string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = bm25.bm25_own_part(docs, asked, "ticker")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [r.doc_id for r in found.collect()] == [1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)


def test_levels_of_tickers_are_made_once(spark):
    """What is found of each level is read from where it was written: no join is left to be made again."""
    from factloom.operators import grading

    rows = [(1, 1, "x", None), (1, 2, "y", None), (1, 3, None, [1, 2]), (1, 4, None, [3])]
    found = grading.source_tickers(spark.createDataFrame(rows, "answer_id int, idx int, ticker string, operands array<int>"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.idx, r.ticker) for r in found.collect()} == {(1, "x"), (2, "y"), (3, "x"), (3, "y"), (4, "x"), (4, "y")}
