"""Line numbers, the score store, the exactly-once log, the filing source, the replay and the suffix automaton, against brute force."""

import difflib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions.text import SuffixAutomaton, coverage, matching_blocks
from factloom.operators import formulas, replay
from factloom.sources import jsonl, submissions
from factloom.sources.score_store import ScoreStore, cached_scores, store_folder
from factloom.sources.submission_source import COLUMNS, SubmissionReader, SubmissionSource, page_columns
from factloom.streaming.log import TraceLog, log_stream
from factloom.streaming.tail import tail


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Files larger than a split, with all ends of lines."""
    sizes = {"a": 5000, "b": 3, "c": 2000, "d": 1}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(b"".join(f"{name}-{i + 1}".encode() + b"x" * (i % 90) + [b"\n", b"\r\n"][name == "c"] for i in range(n)))
    (tmp_path / "e").write_bytes(b"")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "20000")
    spark.conf.set(keys[1], "0")
    try:
        lines = jsonl.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        got = lines.select(F.regexp_extract("file", "([^/]+)$", 1).alias("f"), "line", F.regexp_extract("value", r"^(\w-\d+)", 1).alias("v")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == sum(sizes.values()) and all(r.v == f"{r.f}-{r.line}" for r in got)


def test_strict_scan_names_the_line(spark, tmp_path):
    good = [json.dumps({"id": i, "x": "y"}) for i in range(30)]
    cases = {"blank line": "", "malformed JSON": '{"id": 1', "missing x": '{"id": 1}', "bytes that are not UTF-8": b'{"id": 1, "x": "\xff"}'}
    for n, (problem, bad) in enumerate(cases.items()):
        path = tmp_path / f"{n}.jsonl"
        path.write_bytes(b"\n".join([*(g.encode() for g in good), bad if isinstance(bad, bytes) else bad.encode(), *(g.encode() for g in good)]))
        found = jsonl.bad_lines(spark, str(path), "id int, x string", ("id", "x")).collect()
        assert [(r.line, r.problem) for r in found] == [(31, problem)]
        with pytest.raises(Exception, match=f"{n}.jsonl line 31: {problem}"):
            jsonl.read_strict(spark, str(path), "id int, x string", ("id", "x")).collect()
    assert jsonl.read_strict(spark, str(tmp_path / "0.jsonl"), "id int, x string", ("id", "x"), blank_is_fine=True).count() == 60
    rows = jsonl.read_strict(spark, str(tmp_path / "0.jsonl"), "id int, x string", blank_is_fine=True, numbered=True).collect()
    assert {(r.line, r.id) for r in rows} == {(i + 1, i) for i in range(30)} | {(i + 32, i) for i in range(30)}


def calls_of(spark, lists):
    return spark.createDataFrame([([{"query": q, "text": t} for q, t in x],) for x in lists], "pairs array<struct<query:string,text:string>>")


def test_score_store(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def scorer(calls):
        n = calls.count()
        seen.add(n)
        return calls.select("key", F.transform("pairs", lambda p: F.length(p["text"]).cast("double")).alias("scores"))

    path = store_folder(str(tmp_path), ["model", 3])
    assert path == store_folder(str(tmp_path), ["model", "3"]) != store_folder(str(tmp_path), ["model", 4])
    store = ScoreStore(spark, path)
    first = calls_of(spark, [[("q", "a"), ("q", "bb")], [("q", "a")], [("q", "a")]])
    served = cached_scores(first, scorer, store)
    assert (served.hits, served.misses, served.disabled) == (0, 2, None) and sorted(map(tuple, (r.scores for r in served.scores.collect()))) == [(1.0,), (1.0, 2.0)]
    again = cached_scores(calls_of(spark, [[("q", "a")], [("q", "bb"), ("q", "a")]]), scorer, store)
    assert (again.hits, again.misses) == (1, 1) and again.scores.count() == 2 and store.scores().count() == 3
    before = store.versions()
    assert store.put(store.scores()) == 0 and store.versions() == before  # a merge done again changes nothing
    key = again.scores.first().key
    store.commit(store.next_version(), {"segments": [store.stage(store.scores().withColumn("scores", F.when(F.col("key") == key, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(F.col("scores"))), "segments")]})
    broken = cached_scores(first.union(calls_of(spark, [[("q", "a")], [("q", "bb"), ("q", "a")]])), scorer, store)
    assert broken.disabled.startswith("mid-run: 1 ") and broken.hits == 0 and broken.scores.count() == 3
    store.commit(store.next_version(), {"none": 1})
    assert cached_scores(first, scorer, store).disabled.startswith("at open") and cached_scores(first, scorer, None).disabled == "at open"


def test_log_takes_a_batch_once(spark, tmp_path):
    log = TraceLog(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([("r", 1), ("s", 2)], "run_id string, x long")
    rows.limit(1).write.parquet(log.batch_folder(0))  # an attempt that died before its commit
    assert log.records(rows.schema).count() == 0
    assert log.write(rows, 0) and not log.write(rows, 0) and log.write(rows.limit(1), 1)
    assert sorted((r.batch, r.run_id) for r in log.records(rows.schema).collect()) == [(0, "r"), (0, "s"), (1, "r")]


def test_stream_into_the_log_survives_a_lost_checkpoint(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.jsonl").write_text("".join(json.dumps({"run_id": f"r{i % 2}", "category": "c", "timestamp": f"{n}-{i}"}) + "\n" for i in range(5)) + "no json\n")
    for attempt in range(2):
        stream = tail(spark, str(folder), files=1).select("run_id", "kind", "timestamp")
        log_stream(stream, str(tmp_path / "log"), str(tmp_path / f"checkpoint-{attempt}")).awaitTermination()
    records = TraceLog(spark, str(tmp_path / "log")).records(stream.schema)
    assert records.count() == 15 and records.select("batch").distinct().count() == 3 and records.select("timestamp").distinct().count() == 15


def page(rows, **more):
    return json.dumps({c: [r[i] for r in rows] for i, c in enumerate(COLUMNS)} | more)


def write_pages(tmp_path):
    recent, older, oldest = [("10-K", "n1", "2025-02-01", "d", "2024-12-31"), ("8-K", "n2", "2025-01-01", "d", None)], [("10-Q", "n3", "2023-05-01", "d", "2023-03-31")], "this page is never parsed"
    lines = [f"A\t0\t{page(recent)}", f"A\t1\t{page(older)}", f"A\t2\t{oldest}", f"B\t0\t{page([('10-K', 'n4', '2024-06-01', 'd', '2024-03-31')])}"]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "part-0").write_text("\n".join(lines))


def test_submission_source(spark, tmp_path):
    write_pages(tmp_path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SubmissionSource)
    load = lambda: spark.read.format("submissions").load(f"file://{tmp_path}/pages")
    wanted = load().where("form in ('10-K', '10-Q') and filingDate >= '2024-01-01'")
    assert sorted((r.ticker, r.page, r.pos, r.accessionNumber) for r in wanted.collect()) == [("A", 0, 0, "n1"), ("B", 0, 0, "n4")]
    assert wanted.where("ticker = 'B' and reportDate = '2024-03-31'").count() == 1 and wanted.where("ticker = 'B' and ticker = 'A'").count() == 0
    with pytest.raises(Exception, match="Expecting value|JSONDecodeError"):
        load().collect()  # without a least date every page is read


def test_submission_reader_stops_early():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    reader = SubmissionReader("unused")
    left = list(reader.pushFilters([EqualTo(("form",), "10-K"), In(("form",), ("10-K", "10-Q")), GreaterThan(("filingDate",), "2024"), IsNotNull(("form",)), EqualTo(("pos",), 1)]))
    assert left == [IsNotNull(("form",)), EqualTo(("pos",), 1)] and reader.allowed == {"form": {"10-K"}} and reader.above == "2024"
    for text, problem in (("[]", "no object"), ('{"form": []}', "missing"), (page([], strange=1), "unknown"), (page([]).replace('"form": []', '"form": [1]'), "differ in length")):
        with pytest.raises(ValueError, match=problem):
            page_columns(text, "here")
    assert page_columns(page([], strange=1), "here", ("strange",))["form"] == []


def test_registry_is_closed(spark, tmp_path):
    good = {"name": "N", "cik": "12", "fiscal_year_end_month": 6}
    cases = {"ok": good, "unknown field z of company X": {**good, "z": 1}, "bad company X": {**good, "fiscal_year_end_month": 13}, "bad company X ": {"name": "N", "cik": "12"}}
    for n, (problem, entry) in enumerate(cases.items()):
        (tmp_path / f"{n}.json").write_text(json.dumps({"X": entry}))
        rows = submissions.load_companies(spark, str(tmp_path / f"{n}.json"))
        if n:
            with pytest.raises(Exception, match=problem.strip()):
                rows.collect()
        else:
            assert [tuple(r) for r in rows.collect()] == [("X", "N", "12", 6)]


def test_replay_routes_every_tool(spark):
    resolved = spark.createDataFrame([("A", "revenue", 2024, "FY", 200.0), ("B", "revenue", 2024, "FY", 50.0), ("A", "gross_profit", 2024, "FY", 50.0), ("A", "revenue", 2023, "FY", 100.0)], "entity string, metric string, fy int, fp string, value double").withColumn("end", F.lit("2024-12-31"))
    calls = [
        (1, 1, "get_financial_fact", {"ticker": "A", "metric": "revenue", "fiscal_year": "2024"}, {"found": True, "value": 200.0}),
        (1, 2, "get_financial_fact", {"ticker": "A", "metric": "gross_margin", "fiscal_year": 2024}, {"found": True, "value": 24.0}),
        (1, 3, "calculate", {"operation": "percent_change", "operand_a": 3, "operand_b": 2}, {"found": True, "value": 50.0}),
        (1, 4, "compare_financial_metric", {"metric": "revenue", "fiscal_year": 2024}, {"found": True, "companies": ["A", "B"]}),
        (1, 5, "search_filings", {"query": "x", "ticker": None}, {"result_count": 3}),
        (2, 1, "get_financial_fact", {"ticker": "A", "metric": "revenue", "fiscal_year": 2024, "growth": True}, {"found": True, "value": 100.0}),
        (2, 2, "calculate", {"operation": "divide", "operand_a": 3, "operand_b": 0}, {"found": False}),
        (2, 3, "shell", {}, {}), (2, 4, "calculate", {"operation": "add", "operand_a": 3, "operand_b": 0}, {"found": False}), (3, 1, "calculate", [], None),
    ]
    variant = F.try_parse_json
    df = spark.createDataFrame([(r, o, t, json.dumps(a), json.dumps(x)) for r, o, t, a, x in calls], "run_id long, ord long, tool string, args string, logged string").withColumns({"args": variant("args"), "logged": variant("logged")})
    found = replay.replayed(df, resolved, formulas.registry(spark), lambda s: s.withColumn("result_count", F.lit(3)))
    assert sorted((r.run_id, r.ord, r.field) for r in replay.replay_differences(found).collect()) == [(1, 2, "value"), (2, 3, "error"), (2, 4, "found"), (2, 4, "value"), (3, 1, "error")]
    assert sorted(tuple(r) for r in replay.run_outcomes(found).collect()) == [(1, 5, None, 1), (2, 4, "no replay route for tool shell", 0), (3, 1, "arguments are no object", 0)]


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", max_size=40), st.text("ab c", max_size=25))
def test_blocks_equal_difflib(source, quote):
    want = [b.size for b in difflib.SequenceMatcher(None, source, quote, autojunk=False).get_matching_blocks() if b.size]
    assert sorted(matching_blocks(source, quote)) == sorted(want)
    if source and quote:
        match = difflib.SequenceMatcher(None, source, quote, autojunk=False).find_longest_match()
        assert SuffixAutomaton(quote).longest_in(source)[2] == match.size and (not match.size or SuffixAutomaton(quote).longest_in(source) == (match.a, match.b, match.size))


def test_coverage_of_long_texts_is_fast():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    source = " ".join(rng.choices(words, k=20_000))
    quote = source[5000:9000] + "§" + source[9001:12_000]
    exact, share, longest = coverage(quote, source)
    assert not exact and share > 0.99 and longest == 4000


@pytest.mark.parametrize("name", ["submissions_scan", "numbered_scan", "score_store_reuse", "trace_log_exactly_once", "replay_calls", "replay_run_outcomes"])
def test_queries(spark, sf_dir, name):
    from factloom import catalog
    from tests.oracle import assert_same

    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


def test_run_outcomes_make_the_calls_once(spark, sf_dir):
    from factloom.plans.source_queries import replay_run_outcomes

    assert not any("lineitem" in f or "documents" in f for f in replay_run_outcomes(spark, sf_dir).inputFiles())
