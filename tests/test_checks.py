import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import fiscal, numeric, text
from factloom.operators import corpus, evalstats, goldrank, grading, questions, requests, trace, verification
from factloom.plans import derivation
from factloom.sources import companyfacts, jsonl, sinks, submissions
from factloom.streaming import limiter, tail


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, fiscal.fiscal_year(lit("2024-10-01").cast("date"), lit(9))) == 2025
    assert [one(spark, fiscal.fiscal_quarter(lit(d).cast("date"), lit(1))) for d in ("2024-02-01", "2024-05-01", "2025-01-31")] == [1, 2, 4]
    assert [one(spark, fiscal.is_canonical_date(lit(d))) for d in ("2024-02-29", "2023-02-29", "2024-2-01")] == [True, False, False]
    assert one(spark, numeric.calculate(lit("divide"), lit(1.0), lit("raw"), lit(0.0), lit("raw"))).error == "zero_divisor"
    assert one(spark, numeric.calculate(lit("add"), lit(1.0), lit("raw"), lit(1.0), lit("percent"))).error == "category_mismatch"
    assert one(spark, numeric.calculate(lit("percent_change"), lit(1.5), lit("million"), lit(1000.0), lit("thousand"))).value == 50.0
    assert one(spark, numeric.fixed_point(lit(1.50))) == "1.5" and one(spark, numeric.fixed_point(lit(100.0))) == "100"
    assert one(spark, text.text_matches(lit("March 5, 2024"), lit("It was due on 2024-03-05, they say"))) and not one(spark, text.text_matches(lit("cat"), lit("catalogue")))
    assert one(spark, text.filing_url(lit("0000320193"), lit("0000320193-24-000001"), lit("a b.htm"))).endswith("/320193/000032019324000001/a%20b.htm")
    assert one(spark, text.judge_verdict(lit("PASS\nbecause"))) == "PASS" and one(spark, text.judge_verdict(lit("pass or fail"))) is None
    assert one(spark, text.excerpt(lit("word " * 40))).endswith("word") and one(spark, text.excerpt(lit("a <TABLE>"))) is None


def test_derivation(spark):
    df = spark.createDataFrame([(10.0, 4.0), (1.0, 0.0)], "a double, b double")
    tree = {"operation": "divide", "a": {"column": "a"}, "b": {"column": "b"}}
    assert [r.x for r in df.select(derivation.compile_tree(json.dumps(tree)).alias("x")).collect()] == [2.5, None]
    low, high = derivation.corner_spread(df.limit(1), tree, {"a": 0.5, "b": 0.5}).select("low", "high").first()
    assert (low, high) == (9.5 / 4.5, 10.5 / 3.5)
    with pytest.raises(derivation.DerivationError):
        derivation.compile_tree({"operation": "power", "a": 1, "b": 2})


def test_histories(spark):
    runs = [(q, i, c == "p") for q, s in {"solid": "pppppp", "regr": "ppfffff", "flaky": "pfpfpf", "few": "pp", "bad": "ffpff"}.items() for i, c in enumerate(s)]
    got = {r.qid: r["class"] for r in evalstats.classify_histories(spark.createDataFrame(runs, "qid string, ord int, passed boolean")).collect()}
    assert got == {"solid": "solid", "regr": "regression", "flaky": "flaky", "few": "insufficient", "bad": "regression"}


def test_verification(spark):
    results = spark.createDataFrame([("a", 1, "Total revenue was $72.4 billion in the period, up from last year.", None, "1"), ("a", 2, "10 percent change from 5 = 100%", None, "calculated")], "answer_id string, idx int, text string, header string, chunk_index string")
    claims = spark.createDataFrame(
        [("a", 1, 1, 72.4, "billion", "Total revenue was $72.4 billion"), ("a", 2, 9, 1.0, "raw", "whatever text here"), ("a", 3, 1, 1.0, None, "Total revenue was $72.4 billion"), ("a", 4, 1, 72.4, "billion", "$72"),
         ("a", 5, 1, 72.4, "billion", "profits exploded beyond all imagination"), ("a", 6, 1, 99.0, "billion", "Total revenue was $72.4 billion"), ("a", 7, 1, None, None, "a purely invented statement about risk")],
        "answer_id string, claim_no int, citation_index int, value double, unit string, quote string",
    )
    got = {r.claim_no: r.check for r in verification.claim_verdicts(claims, results).collect()}
    assert got == {1: None, 2: "citation_out_of_range", 3: "malformed_claim", 4: "quote_too_short", 5: "quote_not_found", 6: "value_not_in_quote", 7: "qualitative_quote_not_found"}
    answers = spark.createDataFrame([("a", "What about 8 units?", "Revenue was $72.4 billion ($72,400,000,000) [1] in 2024, 8 units, 10 percent, and 555 extra, minus 1.", True)], "answer_id string, question string, answer_text string, structured boolean")
    assert [(r.category, r.norm) for r in verification.uncovered_numbers(answers, claims.where("claim_no = 1"), results).collect()] == [("scale", 555.0)]
    gate = verification.gate(answers, claims.where("claim_no = 1"), results).first()
    assert gate.withheld and gate.warnings == {"uncovered_number": 1}


def test_citations_decide(spark):
    answers = spark.createDataFrame([("a", "Revenue 50 million [1]. Costs 20 million [2].")], "answer_id string, answer_text string")
    results = spark.createDataFrame([("a", 1, "revenue of 50 million"), ("a", 2, "nothing here")], "answer_id string, idx int, text string")
    expected = spark.createDataFrame([("a", "rev", 50.0, "million", None), ("a", "cost", 20.0, "million", None), ("a", "none", 7.0, "million", None)], "answer_id string, label string, value double, unit string, tolerance double")
    got = {r.value: r.verified for r in verification.citation_verified(expected, answers, results).collect()}
    assert got == {50.0: True, 20.0: False, 7.0: True}
    graded = grading.grade_numbers(expected, answers, results).first()
    assert not graded.passed and graded.missing == ["none"]


def test_grades_against_brute_force(spark):
    rng = random.Random(5)
    values = [1.0, 1.05, 1.1, 4.95, 5.0, 5.05, 100.0, 100.99, 101.0, 102.02, 0.0]
    expected, answers, results, want = [], [], [], {}
    for a in range(60):
        cited = [(i, rng.choice(values), rng.random() < 0.6) for i in range(1, rng.randrange(1, 8))]
        answers.append((a, " ".join(f"A line costs ${v} [{i}]." for i, v, _ in cited)))
        results += [(a, i, f"It holds {v} in all." if ok else "It holds 987654 in all.") for i, v, ok in cited]
        wanted = [(a, f"e{j}", rng.choice(values), "raw", rng.choice([None, 0.01, 0.001, 0.1])) for j in range(rng.randrange(1, 5))]
        expected += wanted
        hit = {label: any(abs(v - t) <= max(abs(t) * (0.01 if share is None else share), 0.05) for _, v, _ in cited) for _, label, t, _, share in wanted}
        near = {label: [ok for _, v, ok in cited if abs(v - t) <= max(abs(t) * 0.01, 0.05)] for _, label, t, _, _ in wanted}
        want[a] = (all(hit[k] and (any(near[k]) or not near[k]) for k in hit), sorted(k for k in hit if not hit[k]))
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((expected, "answer_id long, label string, value double, unit string, tolerance double"), (answers, "answer_id long, answer_text string"), (results, "answer_id long, idx int, text string"))]
    assert {r.answer_id: (r.passed, r.missing) for r in grading.grade_numbers(*frames).collect()} == want


def test_grades_shuffle_each_table_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        expected = spark.range(9).selectExpr("id as answer_id", "'x' as label", "1.0D as value", "'raw' as unit", "0.01D as tolerance")
        answers, results = spark.range(9).selectExpr("id as answer_id", "'It is 1.0 [1].' as answer_text"), spark.range(9).selectExpr("id as answer_id", "1 as idx", "'1.0 in all' as text")
        plan = grading.grade_numbers(expected, answers, results)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= 3  # citations and results meet, and all numbers of an answer


def test_uncovered_numbers_against_brute_force(spark):
    rng = random.Random(6)
    values = [1.0, 1.05, 1.1, 4.95, 5.0, 5.05, 100.0, 100.99, 101.0, 102.02]
    answers, claims, want = [], [], set()
    for a in range(50):
        stated = [(rng.choice(values), rng.random() < 0.3) for _ in range(rng.randrange(1, 8))]
        known = [rng.choice((1, -1)) * rng.choice(values) for _ in range(rng.randrange(0, 4))]
        answers.append((a, "What?", " and ".join(f"it was ({v})" if paren else f"it was {v}" for v, paren in stated), True))
        claims += [(a, i, 1, v, "raw", "q") for i, v in enumerate(known)]
        covered = {}
        for v, paren in stated:  # in brackets: negative, and either sign is right
            hit = any(abs(k - sign * v) <= max(v * 0.01, 0.05) for k in known for sign in ((1, -1) if paren else (1,)))
            covered[-v if paren else v] = covered.get(-v if paren else v, False) or hit
        want |= {(a, "scale", v) for v, hit in covered.items() if not hit}
    answers = spark.createDataFrame(answers, "answer_id long, question string, answer_text string, structured boolean")
    claims = spark.createDataFrame(claims, "answer_id long, claim_no int, citation_index int, value double, unit string, quote string")
    results = spark.createDataFrame([(0, 1, "text", None, "1")], "answer_id long, idx int, text string, header string, chunk_index string")
    assert {tuple(r) for r in verification.uncovered_numbers(answers, claims, results).collect()} == want
    plan = verification.gate(answers, claims, results)._jdf.queryExecution().executedPlan().toString()
    assert not any("Filter" in line and "exists(" in line for line in plan.splitlines())  # each claim is judged once, not once more by a filter


def test_text_forms_of_odd_texts(spark):
    odd = ["Plain text", " two  blanks ", "tab\tand\x1cmore\x0b", "ends with a line\n", "\u2028ends\u2028", "ÄÖ\u00a0ß", "", "   ", "a\x7fb\x00c", None]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("i", text.normalised_text(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: None if t is None else text.normal_form(t) for i, t in enumerate(odd)}


def test_attribution_through_calculations(spark):
    results = spark.createDataFrame([("a", 1, "X", None), ("a", 2, "Y", None), ("a", 3, None, [1, 2]), ("a", 4, None, [3])], "answer_id string, idx int, ticker string, operands array<int>")
    assert sorted(r.ticker for r in grading.source_tickers(results).where("idx = 4").collect()) == ["X", "Y"]
    claims = spark.createDataFrame([("a", 1, 5.0, "raw", 4), ("a", 2, 6.0, "raw", 1)], "answer_id string, ord int, value double, unit string, citation_index int")
    attributed = grading.claim_companies(claims, results)
    entries = spark.createDataFrame([("a", "v5", 5.0, "raw", None, ["X"]), ("a", "v6", 6.0, "raw", None, ["X"])], "answer_id string, label string, value double, unit string, tolerance double, companies array<string>")
    assert [r.label for r in grading.misattributed(entries, attributed).collect()] == ["v5"]
    assert [r.label for r in grading.forbidden_hits(entries, attributed).collect()] == ["v6"]


def test_question_checks(spark):
    schema = "id string, type string, ticker string, tickers array<string>, expected_value double, expected_unit string, expected array<struct<label:string,value:double,companies:array<string>>>, accepted array<string>, refusal_kind string, traps array<struct<value:double,unit:string>>"
    q = spark.createDataFrame([("1", "numeric", "X", None, 100.0, "raw", None, None, None, [(100.5, "raw")]), ("1", "essay", "Z", None, None, None, None, None, "odd", None), ("2", "comparison", None, ["X", "Y"], None, None, [("X-2024", 1.0, ["X"]), ("Q-2024", 2.0, ["Q"])], None, None, None)], schema)
    companies = spark.createDataFrame([("X",), ("Y",)], "ticker string")
    gold = spark.createDataFrame([("1", "value", "X", "a", 2), ("2", "X-2024", "X", "b", 0)], "id string, part string, ticker string, anchor string, found int")
    found = {(r.id, r.check) for r in questions.check_questions(q, companies, gold, spark.createDataFrame([("2",)], "id string")).collect()}
    assert found == {("1", "duplicate_id"), ("1", "unknown_type"), ("2", "id_collision"), ("1", "field_of_other_type"), ("1", "unknown_ticker"), ("2", "entry_company"), ("1", "trap_overlaps_answer"), ("2", "part_without_anchor"), ("2", "anchor_not_found"), ("1", "anchor_in_several_chunks")}


def test_submissions(spark):
    page = ("X", 0, ["10-K", "10-Q", "8-K"], ["0000000001-24-000001", "bad", "0000000001-24-000003"], ["2024-11-01", "2024-08-01", "2024-08-02"], ["a.htm", "b.htm", "c.htm"], ["2024-09-30", "2024-06-30", ""])
    schema = "ticker string, page int, form array<string>, accessionNumber array<string>, filingDate array<string>, primaryDocument array<string>, reportDate array<string>"
    rows = submissions.submission_rows(spark.createDataFrame([page], schema))
    companies = spark.createDataFrame([("X", 9)], "ticker string, fiscal_year_end_month int")
    good, bad = submissions.select_filings(rows, companies)
    assert [(r.primaryDocument, r.fiscal_year) for r in good.collect()] == [("a.htm", 2024)] and {r.reason: r.n for r in bad.collect()} == {"bad_accession": 1}
    assert submissions.pages_needed(rows, companies).first().need_older
    with pytest.raises(Exception, match="differ in length"):
        submissions.submission_rows(spark.createDataFrame([(*page[:6], ["2024-09-30"])], schema)).collect()


def test_companyfacts_and_files(spark, tmp_path):
    facts = {"us-gaap": {"Revenues": {"label": "r", "units": {"USD": [{"end": "2024-01-01", "val": 1}, {"end": "2020-01-01", "val": 2}]}}, "OldTag": {"units": {"USD": [{"end": "2010-01-01", "val": 1}]}}}}
    flat = companyfacts.flatten(spark.createDataFrame([("X", json.dumps(facts))], "ticker string, facts string"))
    assert flat.count() == 3 and [r.tag for r in companyfacts.list_tags(flat, "2024-06-01", "REV").collect()] == ["Revenues"]
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": null}\n{"id": 2}\n')
    assert jsonl.read_strict(spark, str(tmp_path / "a.jsonl"), "id int, x string", ("id",)).count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    with pytest.raises(Exception, match="line 2: blank line"):
        jsonl.read_strict(spark, str(tmp_path / "b.jsonl"), "id int").collect()
    (tmp_path / "r1.json").write_text('[{"id": 1}, {"id": null}]')
    (tmp_path / "r2.json").write_text('{"results": [{"k": 3}], "provenance": {"git_sha": "x"}}')
    reports = jsonl.read_reports(spark, str(tmp_path / "r*.json"))
    assert sorted((r.report, r.ord, r.has) for r in reports.select("report", "ord", jsonl.has_key("raw", "id").alias("has")).collect()) == [("r1.json", 0, True), ("r1.json", 1, True), ("r2.json", 0, False)]


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, x int")
    sinks.write_chunks(chunks, str(tmp_path / "c"))
    sinks.write_chunks(spark.createDataFrame([("A", 9)], "ticker string, x int"), str(tmp_path / "c"))
    assert sorted((r.ticker, r.x) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [("A", 9), ("B", 2)]
    actions = spark.createDataFrame([("a", "replace"), ("b", "delete"), ("c", "add"), ("d", "unchanged")], "relpath string, action string")
    frame = lambda v, *k: spark.createDataFrame([(x, v) for x in k], "relpath string, v int")
    assert sorted((r.relpath, r.v) for r in sinks.apply_manifest(frame(1, "a", "b", "d"), frame(2, "a", "c"), actions).collect()) == [("a", 2), ("c", 2), ("d", 1)]


def test_trace(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"run_id": "r", "name": "search", "timestamp": "2024-01-01", "input": {"query": "q", "n": 3, "ok": 1, "deep": {"x": 4}}, "ok": true, "gone": null, "args": {"gone": 5, "late": 6}}\n\nnot json\n[1]\n{"category": "gate", "run_id": "r", "timestamp": "2024-01-02"}\n')
    records, counts = trace.scan(spark, str(tmp_path / "t.jsonl"))
    assert counts.first() == (2, 2)
    row = records.select(trace.kind().alias("kind"), trace.field("query").alias("q"), trace.field("n").alias("n"), trace.text_of(trace.field("ok")).alias("ok")).orderBy("kind").collect()
    assert [tuple(r) for r in row] == [("gate", None, None, "None"), ("search", "q", "3", "True")]
    # a null that is there ends the search; a dotted name is a path from the top only
    paths = records.where(trace.kind() == "search").select(*[trace.field(n) for n in ("gone", "late", "input.deep.x", "deep.x", "deep")]).first()
    assert tuple(paths) == (None, "6", "4", None, '{"x":4}')
    stream = tail.write_all(tail.run_counts(tail.tail(spark, str(tmp_path))), "tailed", str(tmp_path / "cp"))
    stream.awaitTermination(60)
    assert [(r.run_id, r.n) for r in spark.table("tailed").collect()] == [("r", 2)]


def test_limiter(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:00:{s:02d}", i) for i, s in enumerate((0, 1, 2, 9, 10, 11))]
    df = spark.createDataFrame(rows, "key string, ts string, ord long").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}
    assert {r.ord: r.allowed for r in limiter.limit_batch(df, 2, 10).collect()} == want
    assert all(r.allowed for r in limiter.limit_batch(df, 0, 10).collect())
    path = str(tmp_path / "in")
    df.withColumn("key", F.lit(1).cast("long")).write.parquet(path)
    stream = spark.readStream.schema("key long, ts timestamp, ord long").parquet(path)
    q = limiter.limit_stream(stream, 2, 10).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {r.ord: r.allowed for r in spark.table("limited").collect()} == want


def test_argument_checks(spark):
    schema = {"ticker": {"type": "string", "required": True}, "metric": {"type": "string", "enum": ["revenue"], "required": True}, "fiscal_year": {"type": "integer"}, "form": {"type": "string", "enum": ["10-K", "10-Q"]}}
    args = ['{"ticker": "A", "metric": "x", "fiscal_year": 2024, "form": null}', '{"ticker": "A", "metric": "revenue", "odd": null, "fiscal_year": "x"}', '{"metric": "revenue", "fiscal_year": true}', '{"ticker": "A", "metric": "revenue", "fiscal_year": true}', '{"ticker": "A", "metric": "revenue", "form": "8-K"}', "[1]", "no json"]
    df = spark.createDataFrame(list(enumerate(args)), "i int, a string").orderBy("i")
    got = [r.d for r in df.select("i", requests.argument_defect(F.col("a"), schema, ("metric",)).alias("d")).orderBy("i").collect()]
    assert got == [None, "unexpected:odd", "missing:ticker", "type:fiscal_year", "enum:form", "not_an_object", "not_an_object"]
    assert [one(spark, requests.coerce_year(F.lit(v))) for v in ("2024", "2024.0", "0999", "24", "x")] == [2024, 2024, None, None, None]


def test_index_plan_and_caches(spark):
    f = lambda *flags: one(spark, corpus.rebuild_reason(*map(F.lit, flags)))
    assert f(False, True, True, True, True, True) is None and f(True, False, False, False, False, False) == "forced"
    assert f(False, False, True, True, True, True) == "no_sidecar" and f(False, True, True, True, True, False) == "row_count"
    calls = spark.createDataFrame([("k1", ["a", "b"]), ("k2", ["c"])], "key string, pairs array<string>")
    cached = spark.createDataFrame([("k1", [0.1, 0.2]), ("k2", [0.1, 0.2])], "key string, scores array<double>")
    assert [r.key for r in sinks.cache_misses(calls, cached).collect()] == ["k2"]
    assert calls.select(sinks.score_key()).distinct().count() == 2


def test_texts_and_registry(spark, tmp_path):
    assert one(spark, text.with_unit(F.lit(1.04), F.lit("raw"))) == "1.04" and one(spark, text.with_unit(F.lit(5), F.lit("million"))) == "5 million"
    assert one(spark, text.listed(F.array(*map(F.lit, "abc")), 2)) == "a, b (+1 more)"
    assert len(one(spark, text.fingerprint(F.lit(1), F.lit("x")))) == 12
    (tmp_path / "c.json").write_text('{"X": {"name": "n", "cik": "123", "fiscal_year_end_month": 9}}')
    assert submissions.load_companies(spark, str(tmp_path / "c.json")).first().fiscal_year_end_month == 9
    (tmp_path / "d.json").write_text('{"X": {"name": "n", "cik": "123", "fiscal_year_end_month": 13}}')
    with pytest.raises(Exception, match="bad company"):
        submissions.load_companies(spark, str(tmp_path / "d.json")).collect()
    rows = spark.createDataFrame([("r", 1)], "run_id string, n int")
    assert sinks.append_trace(rows, str(tmp_path / "log")) and sinks.append_trace(rows, str(tmp_path / "log")) and spark.read.json(str(tmp_path / "log")).count() == 2
    assert not sinks.append_trace(rows, str(tmp_path / "c.json" / "x"))
    assert spark.read.json(sinks.write_report(rows, str(tmp_path), "2024-01-01T00")).count() == 1


def test_gold_helpers(spark):
    queries = spark.createDataFrame([("q", "X", ["1", "2"]), ("p", None, ["3"])], "query string, ticker string, qids array<string>")
    assert [(r.query, r.qids) for r in goldrank.filter_queries(queries, ["2", "9"]).collect()] == [("q", ["2"])] and goldrank.filter_queries(queries, None).count() == 2
    keys = "query_id string, ticker string, qid string, part string"
    lost = goldrank.lost_hits(spark.createDataFrame([("q", None, "1", "v"), ("q", "X", "1", "v")], keys), spark.createDataFrame([("q", None, "1", "v")], keys))
    assert [r.ticker for r in lost.collect()] == ["X"]
    searches = spark.createDataFrame([("r1", 1, "q", "X"), ("r2", 2, "q", "X"), ("r3", 3, "z", None)], "run_id string, ord long, query string, ticker string")
    ids = spark.createDataFrame([("r1", "7"), ("r2", "5"), ("r3", "none")], "run_id string, qid string")
    assert [(r.query, r.qids) for r in goldrank.query_set(searches, ids, spark.createDataFrame([("7",), ("5",)], "qid string")).collect()] == [("q", ["5", "7"])]
    parts = spark.createDataFrame([("1", "value", "X", 72.4, "billion", 1), ("2", "value", "X", 20.0, "raw", 0)], "id string, part string, ticker string, value double, unit string, decimals int")
    chunks = spark.createDataFrame([("c1", "X", "we had (72,431) and 20 in 1972.4"), ("c2", "Y", "72,400")], "doc_id string, ticker string, text string")
    assert sorted((r.id, r.token) for r in goldrank.propose_gold(parts, chunks).collect()) == [("1", "(72,431)"), ("2", "20")]
    ranked = goldrank.with_ranks(spark.createDataFrame([("q", 1), ("q", 2)], "query_id string, doc_id int"), bm25=spark.createDataFrame([("q", 1, 5)], "query_id string, doc_id int, rank int"))
    assert {r.doc_id: r.bm25 for r in ranked.collect()} == {1: 5, 2: None}
    causes = spark.createDataFrame([(3, 9, False, True, 1, 20), (9, 3, False, True, 1, 20), (9, 9, True, False, 15, 20), (9, 9, True, True, 15, 20)], "combined_rank int, ce_rank int, rescuable boolean, table_in_final boolean, pool_pos int, pool int")
    assert [r.c for r in causes.select(goldrank.rerank_cause().alias("c")).collect()] == ["rescue", "fusion", "rescue_threshold", "model"]


def test_more_question_checks(spark):
    schema = (
        "id string, type string, ticker string, tickers array<string>, expected_value double, expected_unit string, expected array<struct<label:string,companies:array<string>>>, accepted array<string>, refusal_kind string, "
        "traps array<struct<value:double,unit:string,ticker:string>>, absence_terms array<string>, derivation string, xbrl_source struct<tag:string,accession:string,end:string>"
    )
    rows = [
        ("ok", "numeric", "A", None, 5.0, "raw", None, None, None, [(100.0, "raw", None)], None, None, ("T", "a1", "2024")),
        ("two", "numeric", None, ["A", "B"], 5.0, "percent", None, None, None, [(100.0, "raw", None), (7.0, "raw", "A")], None, "x", ("T", "a1", "2024")),
        ("gone", "text", "A", None, None, None, None, ["x"], None, None, ["term"], "x", None),
    ]
    q = spark.createDataFrame(rows, schema)
    companies = spark.createDataFrame([("A",), ("B",)], "ticker string")
    gold = spark.createDataFrame([("ok", "value", "A", "x", 1), ("two", "value", "A", "x", 1)], "id string, part string, ticker string, anchor string, found int")
    found = sorted((r.id, r.check, r.level) for r in questions.check_questions(q, companies, gold, spark.createDataFrame([], "id string")).collect())
    assert found == [("gone", "field_of_other_type", "error")] * 2 + [("two", "trap_without_ticker", "error")] + [("two", "xbrl_source", "error")] * 3
    facts = spark.createDataFrame([("a1", "T", "2024", 5.04), ("a2", "T", "2024", 6.0), ("a3", "T", "2024", 5.01), ("a1", "U", "2024", 9.0)], "accn string, tag string, end string, val double")
    asked = spark.createDataFrame([("fits", 5.0, 1, ("T", "a1", "2024")), ("wrong", 5.0, 1, ("U", "a1", "2024")), ("none", 5.0, 1, ("T", "a9", "2024"))], "id string, value double, decimals int, xbrl_source struct<tag:string,accession:string,end:string>")
    told = sorted((r.id, r.level, r.message) for r in questions.check_source_facts(asked, facts).collect())
    assert told == [("fits", "warning", "another filing reports 6.0: a2"), ("none", "error", "no fact of T in a9"), ("wrong", "error", "U in a1 is 9.0")]
    chunks = spark.createDataFrame([("ok", "c1", "A"), ("two", "c2", "B"), ("two", "c3", "A")], "id string, doc_id string, ticker string")
    figures = spark.createDataFrame([("c1", 100.5, "raw"), ("c2", 7.0, "raw"), ("c2", 100.0, "raw"), ("c3", 7.0, "percent")], "doc_id string, value double, unit string")
    assert [(r.id, r.message) for r in questions.traps_beside_answer(q, chunks, figures).collect()] == [("ok", "trap 100.0 is printed in gold chunk c1")]


def test_replay_and_report_rules(spark):
    with pytest.raises(ValueError, match="ISO"):
        trace.matches(since="2024-13x")
    assert trace.iso_prefix("2024-01-05T08:53") == "2024-01-05T08:53"
    schema = "run_id int, error string, base_error string, drift boolean, refused_then boolean, refused_now boolean, checks_then string, checks_now string, messages_then string, messages_now string, correct boolean"
    rows = [
        (1, "boom", None, False, True, False, None, None, None, None, True), (2, "boom", "boom", False, True, True, None, None, None, None, True), (3, None, None, True, True, False, None, None, None, None, True),
        (4, None, None, False, True, False, None, None, None, None, None), (5, None, None, False, False, True, None, None, None, None, False), (6, None, None, False, True, True, "a", "b", None, None, True),
        (7, None, None, False, False, False, "a", "b", None, None, True), (8, None, None, False, False, False, None, None, "m", "n", True),
    ]
    df = spark.createDataFrame(rows, schema)
    buckets = lambda logged: [r.b for r in df.select("run_id", trace.replay_bucket(logged).alias("b")).orderBy("run_id").collect()]
    assert buckets(True) == ["errored", "errored", "drifted_change", "recovered_ungraded", "newly_refused_wrong", "check_change", "same", "check_change"]
    assert buckets(False) == ["errored", "errored_unchanged", "recovered_correct", "recovered_ungraded", "newly_refused_wrong", "check_change", "same", "check_change"]
    grades = spark.createDataFrame([(True, False, True, True), (True, False, False, True), (False, True, False, False), (True, False, False, False), (None, True, True, True), (True, True, True, True)], "was_correct boolean, correct boolean, drift boolean, refused_now boolean")
    assert [r.g for r in grades.select(trace.grade_change().alias("g")).collect()] == ["tool_drift", "refused", "now_correct", "now_wrong", None, None]
    row = spark.createDataFrame([("x", True, 0), ("x", False, 2), (None, False, 2)], "answer string, has_citation boolean, n_warnings int")
    assert [r.f for r in row.select(evalstats.citation_flags().alias("f")).collect()] == ["", "  [no citation]  [unverified citation]", ""]
    long = spark.createDataFrame([("a\n b",), ("x" * 200,)], "t string").select(evalstats.truncated(F.col("t")).alias("t")).collect()
    assert long[0].t == "a b" and len(long[1].t) == 150 and long[1].t.endswith("x...")
    asked = spark.createDataFrame([("1", "A", None, "q?", "numeric", "c"), ("2", None, ["A", "B"], "q?", "judged", None)], "id string, ticker string, tickers array<string>, question string, type string, category string")
    assert [tuple(r) for r in evalstats.row_identity(asked).orderBy("id").collect()] == [("1", "A", "q?", "numeric", "c"), ("2", "A,B", "q?", "judged", None)]
    report = spark.createDataFrame([('{"queries": [{"query": "q", "ticker": null, "qids": ["1", "2"]}]}',)], "r string").select(F.try_parse_json("r").alias("report"))
    assert [tuple(r) for r in goldrank.queries_of_report(report).collect()] == [("q", None, ["1", "2"])]
    order = spark.createDataFrame([("regression", 9, 3, 1, "b"), ("regression", 9, 6, 5, "a"), ("flaky", 10, 0, 4, "d"), ("flaky", 10, 0, 2, "c")], "class string, runs int, fail_streak int, passes int, qid string")
    assert [r.qid for r in order.orderBy(*evalstats.section_order(order)).collect()] == ["c", "d", "a", "b"]


def test_text_rules_without_a_query(spark):
    df = spark.createDataFrame([("Non-GAAP “Net”  income ﬁgures", "See [1] and [ACME 10-K reportDate=2024-01-01] end [2]")], "a string, b string")
    row = df.select(text.folded(F.col("a")).alias("a"), text.without_citations(F.col("b")).alias("b")).first()
    assert row.a == "non gaap net income figures" and row.b.split() == ["See", "and", "end"]
    years = spark.createDataFrame([("FY", "2026-01-31", 2025), ("Q1", "2026-01-31", 2025)], "fp string, end string, fy int")
    assert [r.y for r in years.select(fiscal.resolved_fiscal_year(F.col("fp"), F.col("end").cast("date"), F.col("fy")).alias("y")).collect()] == [2026, 2025]
