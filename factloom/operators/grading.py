"""Grading answers: numbers, comparisons, texts, attribution to companies, and traps.

expected (answer_id, label, value, unit, tolerance, companies); claims (answer_id, ord, value, unit, citation_index);
results (answer_id, idx, ticker, operands); answers (answer_id, answer_text, type, withheld).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import numbers
from factloom.functions.numeric import band_buckets, category, normalised, tolerance_bucket
from factloom.functions.text import text_matches
from factloom.sources.shared import written
from factloom.operators.verification import BRACKET, is_near, judged_citations, nearest, without_non_claims


def _near(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of expected values (answer_id, value, unit, tolerance) and numbers (answer_id, category, norm, ...) inside their bands: an
    equi-join on the answer, the category and the bucket of the tolerance, so an answer with many numbers is no quadratic key."""
    norm = normalised(F.col("value"), F.col("unit"))
    e = expected.withColumns({"category": category(F.col("unit")), "_n": norm, "_band": F.greatest(F.abs(norm) * F.coalesce("tolerance", F.lit(0.01)), F.lit(0.05))})
    e = e.withColumn("_bucket", F.explode(band_buckets(F.col("_n"), F.col("_band"))))
    f = found.withColumn("_bucket", tolerance_bucket(F.col("norm")))
    return e.join(f, ["answer_id", "category", "_bucket"]).where(F.abs(F.col("norm") - F.col("_n")) <= F.col("_band"))


def answer_numbers(answers: DataFrame) -> DataFrame:
    plain = without_non_claims(F.regexp_replace("answer_text", BRACKET, ""))
    return answers.select("answer_id", F.explode(numbers.numbers_in(plain)).alias("n")).select("answer_id", category(F.col("n.unit")).alias("category"), normalised(F.col("n.value"), F.col("n.unit")).alias("norm"))


#: Sides of ``grade_numbers``: numbers of the answer, numbers whose citation fails or holds, expected values.
SAID, FAILS, HOLDS, EXPECTED = range(4)


def grade_numbers(expected: DataFrame, answers: DataFrame, results: DataFrame) -> DataFrame:
    """(answer_id, passed, missing): every expected value stands in the answer and is not miscited everywhere.

    Whether a number lies in an expected value's band is told by the nearest ones on both sides: all numbers of an answer are dealt
    to one task and sorted, once up and once down, so an answer with many numbers is no quadratic key and no pairs are shuffled.
    """
    answers = answers.where("answer_id is not null")  # the join below asks for it: both readers share one plan
    side = lambda df, number, what, label, tolerance: df.select("answer_id", (F.col("category") == "percent").alias("_percent"), number.alias("_at"), what.cast("byte").alias("_side"), label.alias("label"), tolerance.alias("_share"))
    none, no_label = F.lit(None).cast("double"), F.lit(None).cast("string")
    wanted = expected.where("answer_id is not null and value is not null and unit is not null").withColumn("category", category(F.col("unit")))
    rows = side(wanted, normalised(F.col("value"), F.col("unit")), F.lit(EXPECTED), F.col("label"), F.coalesce(F.col("tolerance").cast("double"), F.lit(0.01)))
    rows = rows.unionByName(side(answer_numbers(answers), F.col("norm"), F.lit(SAID), no_label, none))
    cited = judged_citations(answers, results).where("ok is not null")
    rows = rows.unionByName(side(cited, F.col("norm"), F.when(F.col("ok"), HOLDS).otherwise(FAILS), no_label, none)).repartition("answer_id")

    rows = nearest(rows, {"said": F.col("_side") == SAID, "fails": F.col("_side") == FAILS, "holds": F.col("_side") == HOLDS})
    near = lambda kind, share: is_near(kind, F.greatest(F.abs("_at") * share, F.lit(0.05)))
    graded = rows.where(F.col("_side") == EXPECTED).select("answer_id", "label", near("said", F.col("_share")).alias("hit"), (near("holds", F.lit(0.01)) | ~near("fails", F.lit(0.01))).alias("verified"))
    return graded.groupBy("answer_id").agg(F.bool_and(F.col("hit") & F.col("verified")).alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("label")))).alias("missing"))


def grade_texts(accepted: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, passed): any accepted text stands in the answer as whole words, dates in any spelling."""
    joined = accepted.join(answers.select("answer_id", "answer_text"), "answer_id")
    return joined.groupBy("answer_id").agg(F.bool_or(text_matches(F.col("text"), F.col("answer_text"))).alias("passed"))


def source_tickers(results: DataFrame) -> DataFrame:
    """(answer_id, idx, ticker): companies that each result rests on; a calculation rests on those of its operands.

    Operands point to earlier results, so each round resolves one more level; it goes on until nothing is added. Each level is
    written, so that a round reads the level before it instead of making all levels anew.
    """
    found = level = written(results.where("ticker is not null").select("answer_id", "idx", "ticker").distinct(), "tickers")
    edges = written(results.where("ticker is null").select("answer_id", "idx", F.explode("operands").alias("operand")).distinct(), "operands")
    while not level.isEmpty():
        level = edges.join(level.select("answer_id", F.col("idx").alias("operand"), "ticker"), ["answer_id", "operand"]).select("answer_id", "idx", "ticker").distinct()
        level = written(level.join(found, ["answer_id", "idx", "ticker"], "left_anti"), "tickers")
        found = found.unionByName(level)
    return found


def claim_companies(claims: DataFrame, results: DataFrame) -> DataFrame:
    """(answer_id, ord, value, unit, tickers): sorted companies behind each numeric claim."""
    tickers = source_tickers(results).withColumnRenamed("idx", "citation_index")
    joined = claims.where("value is not null").join(tickers, ["answer_id", "citation_index"], "left")
    return joined.groupBy("answer_id", "ord", "value", "unit").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))


def _stated(attributed: DataFrame) -> DataFrame:
    return attributed.select("answer_id", category(F.col("unit")).alias("category"), normalised(F.col("value"), F.col("unit")).alias("norm"), "tickers")


def misattributed(expected: DataFrame, attributed: DataFrame) -> DataFrame:
    """Expected values (with ``companies``) that claims state, but none with exactly their companies."""
    joined = _near(expected, _stated(attributed))
    return joined.groupBy("answer_id", "label").agg(F.bool_or(F.array_sort("companies") == F.col("tickers")).alias("right")).where("not right").select("answer_id", "label")


def forbidden_hits(traps: DataFrame, attributed: DataFrame) -> DataFrame:
    """Traps (answer_id, label, value, unit, tolerance, companies or null) that a claim states, with the trap's companies if named."""
    own = F.col("companies").isNull() | (F.array_sort("companies") == F.col("tickers"))
    return _near(traps, _stated(attributed)).where(own).select("answer_id", "label").distinct()


def final_grade(kind: Column, withheld: Column, value_passed: Column, accepted_passed: Column, attributed: Column, trapped: Column) -> Column:
    """Outcome in order: a refusal by the gate fails, then the value or an accepted text, then attribution, then traps."""
    deterministic = kind.isin("numeric", "comparison", "text")
    return (
        F.when(~deterministic, "judged").when(withheld, "withheld").when(~(F.coalesce(value_passed, F.lit(False)) | F.coalesce(accepted_passed, F.lit(False))), "wrong_value")
        .when(attributed, "misattributed").when(trapped, "trap").otherwise("passed")
    )


def judge_criteria(template: Column, entry: Column, value: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{entry}"), entry), F.lit("{value}"), value)
