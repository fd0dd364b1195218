"""Evaluation analytics: pass rates, streaks, flakiness classes, A/B comparison and report selection.

Results are rows (report, ord, qid, answer, passed, ...). A row without an answer is an infrastructure error and
no outcome. Histories of a question are windows over its own rows, ordered by report and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numeric import rounded, wilson

#: Fixed values of the classification and the comparison.
HISTORY = 20
LEAST_RUNS = 5
SOLID_RATE = 0.80
STREAK = 5
TRANSITIONS = 3
MOSTLY_FAILING = 0.5
REGRESSED = -0.5
BASE_FLOOR = 1 / 3
TOTAL_PERCENT = 14
TOTAL_RUNS = 20
EPSILON = 1e-9


def error_type(detail: Column) -> Column:
    """What stands before the first colon of an error text, else 'unknown'."""
    return F.when(detail.contains(":"), F.substring_index(detail, ":", 1)).otherwise("unknown")


def truncate_at_infra_error(rows: DataFrame) -> DataFrame:
    """Rows of each report before its first row without an answer."""
    first = F.min(F.when(F.col("answer").isNull(), F.col("ord"))).over(Window.partitionBy("report"))
    return rows.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("ord") < F.col("_first"))).drop("_first")


def pass_rates(rows: DataFrame, *keys: str) -> DataFrame:
    """runs, passes and Wilson bounds of each key over the rows with an answer."""
    out = rows.where("answer is not null").groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if("passed").alias("passes"))
    low, high = wilson(F.col("passes"), F.col("runs"))
    return out.withColumn("low", rounded(low, 6)).withColumn("high", rounded(high, 6))


def excluded_counts(rows: DataFrame) -> DataFrame:
    return rows.where("answer is null").groupBy("qid", error_type(F.col("detail")).alias("error")).agg(F.count("*").alias("n"))


def classify_histories(rows: DataFrame) -> DataFrame:
    """Class of each question from its last ``HISTORY`` outcomes (qid, ord, passed; ord orders a question's runs)."""
    recent = rows.withColumn("_back", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("ord").desc()))).where(F.col("_back") <= HISTORY)
    recent = recent.withColumn("_changed", F.col("passed") != F.lag("passed").over(Window.partitionBy("qid").orderBy("ord")))
    streak = lambda want: F.coalesce(F.min(F.when(F.col("passed") != want, F.col("_back"))) - 1, F.count("*"))
    out = recent.groupBy("qid").agg(
        F.count("*").alias("runs"), F.count_if("passed").alias("passes"), F.count_if("_changed").alias("transitions"),
        streak(False).alias("fail_streak"), streak(True).alias("pass_streak"),
    )
    rate = F.col("passes") / F.col("runs")
    label = (
        F.when(F.col("runs") < LEAST_RUNS, "insufficient").when(F.col("fail_streak") >= STREAK, "regression").when((F.col("pass_streak") >= STREAK) | (rate >= SOLID_RATE), "solid")
        .when(F.col("transitions") >= TRANSITIONS, "flaky").when(rate < MOSTLY_FAILING, "regression").otherwise("flaky")
    )
    low, high = wilson(F.col("passes"), F.col("runs"))
    return out.withColumns({"class": label, "low": rounded(low, 6), "high": rounded(high, 6)})


def section_order(classified: DataFrame) -> list[Column]:
    """Order of a report's sections: regressions by their streak, the others by rate and id."""
    rate = F.col("passes") / F.col("runs")
    return [F.col("class"), F.when(F.col("class") == "regression", -F.col("fail_streak")).otherwise(0), F.when(F.col("class") != "regression", rate), F.col("qid")]


def is_excluded(include_dirty: bool = False) -> Column:
    """Reports that a comparison leaves out: unknown commit, dirty tree, unverified snapshot, an index known to be stale."""
    unknown = F.col("git_sha").isNull() | (F.col("git_sha") == "")
    dirty = F.lit(False) if include_dirty else ~F.col("git_dirty").eqNullSafe(F.lit(False))
    return unknown | dirty | ~F.col("snapshot_verified").eqNullSafe(F.lit(True)) | F.col("index_matches_chunks").eqNullSafe(F.lit(False))


def default_pair(reports: DataFrame) -> DataFrame:
    """One row (base, candidate): the fingerprints of the two groups whose last reports are the latest."""
    groups = reports.groupBy("fingerprint").agg(F.max("report").alias("last"))
    latest = groups.orderBy(F.col("last").desc()).limit(2).agg(F.array_sort(F.collect_list(F.struct("last", "fingerprint"))).alias("two"))
    return latest.where("size(two) = 2").select(F.col("two")[0]["fingerprint"].alias("base"), F.col("two")[1]["fingerprint"].alias("candidate"))


def compare(rows: DataFrame) -> DataFrame:
    """Rates of both sides per question (side, qid, passed; side is base or candidate), flags, and presence on one side only."""
    sides = rows.groupBy("qid").agg(*[f(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{n}") for s in ("base", "candidate") for n, f, c in (("runs", F.count, "passed"), ("passes", lambda x: F.sum(x.cast("int")), "passed"))])
    change = F.col("candidate_passes") / F.col("candidate_runs") - F.col("base_passes") / F.col("base_runs")
    both = (F.col("base_runs") > 0) & (F.col("candidate_runs") > 0)
    out = sides.withColumn("presence", F.when(both, "both").when(F.col("base_runs") > 0, "base_only").otherwise("candidate_only")).withColumn("change", F.when(both, change))
    flags = F.array_compact(F.array(
        F.when(F.col("change") <= REGRESSED + EPSILON, "REGRESSED").when(F.col("change") < -EPSILON, "watch").when(F.col("change") > EPSILON, "improved"),
        F.when(both & (F.col("base_passes") / F.col("base_runs") <= BASE_FLOOR + EPSILON), "low base"),
        F.when(both & (F.abs(F.col("change")) * F.least("base_runs", "candidate_runs") <= 1 + EPSILON) & (F.abs(F.col("change")) > EPSILON), "within one pass"),
    ))
    return out.withColumn("flags", F.array_join(flags, ",")).withColumn("change", rounded(F.col("change"), 6))


def total_change(compared: DataFrame) -> DataFrame:
    """One row: expected minus actual passes of the candidate against its threshold; counts only from ``TOTAL_RUNS`` runs."""
    both = compared.where("presence = 'both'")
    lost = F.sum((F.col("base_passes") / F.col("base_runs") - F.col("candidate_passes") / F.col("candidate_runs")) * F.col("candidate_runs"))
    out = both.agg(F.coalesce(F.sum("candidate_runs"), F.lit(0)).alias("runs"), rounded(lost, 6).alias("lost"))
    out = out.withColumn("threshold", F.expr(f"({TOTAL_PERCENT} * runs + 99) div 100"))
    return out.withColumn("regressed", F.coalesce((F.col("runs") >= TOTAL_RUNS) & (F.col("lost") >= F.col("threshold")), F.lit(False)))


def consistency(reports: DataFrame, columns: list[str]) -> DataFrame:
    """(column, side, n_values, differs): columns that hold more than one value on a side or other values on the two sides."""
    long = reports.select("side", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value")) for c in columns])).alias("x")).select("side", "x.*")
    sets = long.groupBy("column").agg(*[F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("value")))).alias(s) for s in ("base", "candidate")])
    return sets.select("column", F.size("base").alias("n_base"), F.size("candidate").alias("n_candidate"), (F.col("base") != F.col("candidate")).alias("differs")).where("n_base > 1 or n_candidate > 1 or differs")


def breakdown(rows: DataFrame) -> DataFrame:
    """Counts per type and per category in one pass, groups in first-seen order; rows without the key are left out."""
    sets = rows.select("ord", "answer", "passed", "n_warnings", "has_citation", F.explode(F.array(F.struct(F.lit("type").alias("by"), F.col("type").alias("group")), F.struct(F.lit("category").alias("by"), F.col("category").alias("group")))).alias("g"))
    answered = F.col("answer").isNotNull()
    out = sets.where("g.group is not null").groupBy("g.by", "g.group").agg(
        F.count("*").alias("total"), F.count_if(answered & F.col("passed")).alias("passed"), F.count_if(answered & ~F.col("has_citation")).alias("no_citation"),
        F.count_if(F.col("n_warnings") > 0).alias("unverified"), F.count_if(~answered).alias("errors"), F.min("ord").alias("first_seen"),
    )
    return out


def gate_outcomes(rows: DataFrame) -> DataFrame:
    """One row of gate counts (withheld, would_have_passed, passed, type): false and true positives, false negatives, and the
    false-positive rate over refusals, null if nothing was refused."""
    judged = F.col("type") == "judged"
    label = F.when(judged, "judged").when(F.col("withheld").isNull(), "no_gate").when(F.col("withheld") & F.col("would_have_passed").isNull(), "ungraded").when(F.col("withheld") & F.col("would_have_passed"), "false_positive").when(F.col("withheld"), "true_positive").when(~F.col("passed"), "false_negative").otherwise("true_negative")
    counts = rows.select(label.alias("label")).agg(*[F.count_if(F.col("label") == x).alias(x) for x in ("judged", "no_gate", "ungraded", "false_positive", "true_positive", "false_negative", "true_negative")])
    return counts.withColumn("false_positive_rate", rounded(F.try_divide(F.col("false_positive").cast("double"), F.col("false_positive") + F.col("true_positive")), 6))


def tally(rows: DataFrame) -> DataFrame:
    """(side, qid, runs, passes, withheld): rows (side, qid, passed, withheld), where a null counts as false."""
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return rows.groupBy("side", "qid").agg(F.count("*").alias("runs"), count("passed").alias("passes"), count("withheld").alias("withheld"))


def gate_label() -> Column:
    """What a row (has_outcome, would_have_passed, type, n_warnings, passed, has_citation) says about the gate; ``has_outcome``: whether its report
    has the field at all, be it null."""
    refused = F.coalesce(F.col("n_warnings"), F.lit(0)) > 0
    return (
        F.when(~F.col("has_outcome"), "unknown_pre_instrumentation").when(F.col("type") == "judged", "excluded").when(refused & F.coalesce("would_have_passed", F.lit(False)), "false_positive").when(refused, "true_positive")
        .when(~F.col("passed") & F.col("has_citation"), "false_negative_candidate").otherwise("not_gate_attributable")
    )


def false_positives_by_check(rows: DataFrame) -> DataFrame:
    """(check, n): how many falsely refused rows a check has warned of; rows as in ``gate_label`` and ``checks``, the checks of a row's warnings."""
    wrong = rows.where(gate_label() == "false_positive")
    return wrong.select(F.explode(F.array_distinct("checks")).alias("check")).groupBy("check").agg(F.count("*").alias("n"))


def row_identity(questions: DataFrame) -> DataFrame:
    """The fields of a question that a report row repeats: the one ticker or the list as text, and category and trap if there are such."""
    also = [c for c in ("category", "trap") if c in questions.columns]
    return questions.select("id", F.coalesce("ticker", F.array_join("tickers", ",")).alias("ticker"), "question", "type", *also)


def truncated(text: Column, limit: int = 150) -> Column:
    """One line of at most ``limit`` characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def citation_flags() -> Column:
    """Marks of a row (answer, has_citation, n_warnings); a row without an answer is an error and has none."""
    flags = F.concat(F.when(F.coalesce("has_citation", F.lit(False)), "").otherwise("  [no citation]"), F.when(F.coalesce("n_warnings", F.lit(0)) > 0, "  [unverified citation]").otherwise(""))
    return F.when(F.col("answer").isNull(), "").otherwise(flags)
