import pytest
from pyspark.sql import functions as F

from factloom.operators import corpus, reports, verification


def test_question_select(spark):
    q = spark.createDataFrame([("a", False), ("b", True), ("c", None)], "id string, skip boolean")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(reports.select_questions(q)) == ["a", "c"] and ids(reports.select_questions(q, with_skipped=True)) == ["a", "b", "c"]
    assert ids(reports.select_questions(q, ["b", "a"])) == ["a", "b"] and ids(reports.select_questions(q, [])) == []
    with pytest.raises(ValueError, match="x, y"):
        reports.select_questions(q, ["y", "a", "x"])


def test_operand_grounding(spark):
    results = spark.createDataFrame([(1, 1, "revenue of $250 million and 12.5%"), (1, 2, "costs were 77 and (431)")], "answer_id long, idx int, text string")
    rows = [("a", 250.0, "million", 1, "ok"), ("b", 250.9, "million", 1, "ok"), ("c", 253.0, "million", 1, "ungroundable"), ("d", 12.5, "raw", 1, "wrong_unit"), ("e", 77.0, "raw", 1, "wrong_index"),
            ("f", 1e9, "raw", 2, "ungroundable"), ("g", 77.0, "raw", 3, "bad_index"), ("h", 77.0, "raw", 0, "bad_index"), ("i", 250000.0, "thousand", 1, "ok"), ("j", -431.0, "raw", 2, "ok")]
    operands = spark.createDataFrame([(1, *r[:4]) for r in rows], "answer_id long, operand string, value double, unit string, citation_index int")
    counts = results.groupBy("answer_id").agg(F.count("*").alias("n_results"))
    got = {r.operand: r for r in verification.operand_grounding(operands, counts, verification.source_numbers(results)).collect()}
    assert {k: v.outcome for k, v in got.items()} == {r[0]: r[4] for r in rows}
    assert got["d"].other_unit == "percent" and got["e"].other_index == 2 and got["a"].other_unit is None


def test_base_and_provenance(spark):
    columns = "report string, gold_sha string, corpus_sha string, index_matches boolean"
    base = spark.createDataFrame([("a", "g", "c", True), ("b", "g", None, False), ("c", None, "", None)], columns)
    now = spark.createDataFrame([("a", "g", "d", None), ("b", "h", "c", True), ("c", None, None, False)], columns)
    got = {r.report: (r.refused, r.notes) for r in reports.base_verdict(base, now).collect()}
    assert got == {"a": (False, ["corpus_differs"]), "b": (True, ["base_corpus_unknown", "base_index_stale"]), "c": (False, ["corpus_unknown", "base_corpus_unknown", "index_stale"])}
    corpus = spark.createDataFrame([(3, "x")], "files long, sha string")
    state = lambda side: reports.provenance(corpus, side).first().index_matches
    side = lambda *shas: spark.createDataFrame([(s,) for s in shas], "sha string")
    assert (state(side("x")), state(side("y")), state(side()), state(side(None)), state(None)) == (True, False, None, None, None)


def test_observed_differences(spark):
    rows = [(1, 1, "calculate", '{"found": true, "value": 2}', '{"found": true, "value": 3}'), (1, 2, "calculate", '{"found": true}', '{"found": true, "value": null}'),
            (1, 3, "search_filings", '{"result_count": 5, "took": 1}', '{"result_count": 5, "took": 9}'), (1, 4, "shell", "{}", "{}"), (1, 5, "search_filings", '{"result_count": 5}', None)]
    calls = spark.createDataFrame(rows, "run_id int, ord int, tool string, logged string, replayed string").withColumns({c: F.try_parse_json(c) for c in ("logged", "replayed")})
    got = {(r.ord, r.field, r.logged, r.replayed) for r in reports.observed_differences(calls).collect()}
    assert got == {(1, "value", "2", "3"), (4, "no_route", None, None), (5, "result_count", "5", None)}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for text in ("plain ~ text", "tab\tline\n\r", "bell\x07 \x1b[31m", "caf\u00e9 \u4e2d \U0001f600", "", "\x7f"):
        assert one(reports.printable(F.lit(text))) == "".join(c if c.isascii() and c.isprintable() else ascii(c)[1:-1] for c in text)
    assert one(reports.clipped(F.lit("abcdef"), 4)) == "abcd..." and one(reports.clipped(F.lit("abcd"), 4)) == "abcd"
    path = lambda t: one(reports.questions_path(F.try_parse_json(F.lit(t))))
    assert path('{"provenance": {"config": {"questions": {"path": "v2"}}}}') == "v2"
    assert {path(t) for t in ("{}", '{"provenance": null}', '{"provenance": {"config": {"questions": "v2"}}}', '{"provenance": {"config": {"questions": {"path": ""}}}}')} == {reports.DEFAULT_QUESTIONS}
    none = F.lit(None).cast("string")
    assert one(reports.fact_source(F.lit("T"), F.lit("2020-01-01"), F.lit("1"), none, F.lit("2020-02-01"), none)) == '{"ticker":"T","period_end":"2020-01-01","accession":"1","filed":"2020-02-01"}'
    assert (reports.confidence_label(1.96), reports.confidence_label(1.0)) == ("95% CI", "68% CI")


def test_repeated_ids_are_an_error(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    assert corpus.require_unique(ids("a", "b")).count() == 2 and corpus.require_unique(ids()).count() == 0
    with pytest.raises(ValueError, match="repeated id: a, b, c, d, e$"):
        corpus.require_unique(ids(*"gfedcbabcdefg", "a", "z"))


def test_operand_trials_are_few_and_miss_no_band_edge(spark):
    values = [0.0, 0.04, 0.05, 4.99, 5.0, 5.01, -5.0, 99.95, 1234.5, -7e6] + [1.07**i for i in range(200)]
    rows = [(1, i, v, "raw", i) for i, v in enumerate(values, 1)]
    operands = spark.createDataFrame(rows, "answer_id long, operand int, value double, unit string, citation_index int")
    assert verification.unit_trials(operands).count() < 7 * len(values)
    for way in (-1, 1):
        near = [(1, i, v + way * max(abs(v) * 0.01, 0.05) * 0.999999, "raw") for i, v in enumerate(values, 1)]
        found = spark.createDataFrame(near, "answer_id long, idx int, value double, unit string")
        counts = spark.createDataFrame([(1, len(values))], "answer_id long, n_results int")
        assert {r.outcome for r in verification.operand_grounding(operands, counts, found).collect()} == {"ok"}
