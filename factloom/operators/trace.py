"""Trace logs: lenient scan, filters, counts, run timelines, and grouping of runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed pattern: a UTC time from the year on, cut off after any of its parts.
ISO_PREFIX = re.compile(r"\d{4}(-\d{2}(-\d{2}(T\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?)?)?")


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, one row of counts) of a JSON-lines log. Blank lines are ignored; lines that are no JSON object are counted."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where("trim(value) <> ''")
    parsed = lines.withColumn("raw", F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant("raw").startswith("OBJECT"), F.lit(False))
    records = parsed.where(is_object).select("ord", "raw")
    return records, parsed.agg(F.count_if(is_object).alias("records"), F.count_if(~is_object).alias("malformed"))


def text_of(value: Column) -> Column:
    """A field as Python prints it: None, True, False."""
    return F.when(value.isNull(), "None").when(value == "true", "True").when(value == "false", "False").otherwise(value)


def field(name: str, raw: str = "raw") -> Column:
    """A field by name, taken from the first of the record, its ``input`` and its ``args`` that has it, even as null; a dotted
    name is a path from the top only."""
    quoted = lambda p: p if p.replace("_", "").isalnum() else f"`{p}`"
    at = lambda path: F.try_variant_get(F.col(raw), f"$.{path}", "string")
    if "." in name:
        return at(".".join(map(quoted, name.split("."))))
    keys = lambda path: F.map_keys(F.try_variant_get(F.col(raw), f"${path}", "map<string,variant>"))
    rule = F.lit(None).cast("string")
    for container in ("args", "input", ""):
        has = F.coalesce(F.array_contains(keys(f".{container}" if container else ""), name), F.lit(False))
        rule = F.when(has, at(f"{container}.{quoted(name)}" if container else quoted(name))).otherwise(rule)
    return rule


def kind(raw: str = "raw") -> Column:
    """The event's category or the span's name."""
    return F.coalesce(F.try_variant_get(F.col(raw), "$.category", "string"), F.try_variant_get(F.col(raw), "$.name", "string"))


def iso_prefix(text: str) -> str:
    """The text itself if a time filter can be compared with it, else an error."""
    if not ISO_PREFIX.fullmatch(text):
        raise ValueError(f"expected the beginning of an ISO time in UTC, got {text!r}")
    return text


def matches(since: str | None = None, until: str | None = None, kinds: tuple[str, ...] = (), runs: tuple[str, ...] = (), equals: dict[str, str] | None = None) -> Column:
    """Filter on timestamp (text order, half open), kind, run and fields; ``None`` matches null and absent."""
    rule = F.lit(True)
    if since:
        rule &= F.col("timestamp") >= iso_prefix(since)
    if until:
        rule &= F.col("timestamp") < iso_prefix(until)
    if kinds:
        rule &= F.col("kind").isin(*kinds)
    if runs:
        rule &= F.col("run_id").isin(*runs)
    for name, value in (equals or {}).items():
        rule &= text_of(F.col(name).cast("string")) == value
    return rule


def count_by(records: DataFrame, *fields: str, limit: int | None = None) -> DataFrame:
    """Counts of field combinations with the place of the first; with a ``limit`` the most common ones, ties by first appearance."""
    out = records.groupBy(*[text_of(F.col(f).cast("string")).alias(f) for f in fields]).agg(F.count("*").alias("n"), F.min("ord").alias("first_seen"))
    return out.orderBy(F.col("n").desc(), "first_seen").limit(limit) if limit else out


def timelines(records: DataFrame) -> DataFrame:
    """(run_id, first, n, steps): a run's steps in time order, joined by ' > '. Long runs sort inside one row of their run."""
    steps = F.array_sort(F.collect_list(F.struct("timestamp", "ord", "step")))
    out = records.where("run_id is not null").groupBy("run_id").agg(F.min("timestamp").alias("first"), F.count("*").alias("n"), steps.alias("steps"))
    return out.withColumn("steps", F.array_join(F.transform("steps", lambda s: s["step"]), " > "))


def question_ids(roots: DataFrame, questions: DataFrame) -> DataFrame:
    """(run_id, qid): the question whose text equals a run's root question, '?' if none does; of repeated texts and roots the last counts."""
    last = lambda df, key, order: df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")
    texts = last(questions.withColumn("_text", F.trim("question")), "_text", "ord").select("_text", F.col("id").alias("qid"))
    return last(roots, "run_id", "ord").withColumn("_text", F.trim("question")).join(texts, "_text", "left").select("run_id", F.coalesce("qid", F.lit("?")).alias("qid"))


def final_step(records: DataFrame, output: str = "answer") -> DataFrame:
    """Of each run the last record whose text equals the run's output."""
    window = Window.partitionBy("run_id").orderBy(F.col("ord").desc())
    return records.where(F.col("text") == F.col(output)).withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")


def replay_outcomes(base: DataFrame, replayed: DataFrame) -> DataFrame:
    """(run_id, presence, change): verdicts of a replay (run_id, withheld, correct) against those logged.

    change: recovered or newly_refused, with the grade of the answer it concerns (correct, wrong, ungraded), or same.
    """
    b = base.select("run_id", F.col("withheld").alias("was"), F.col("correct").alias("was_correct"))
    joined = b.join(replayed, "run_id", "full_outer")
    grade = lambda c: F.when(c.isNull(), "ungraded").when(c, "correct").otherwise("wrong")
    presence = F.when(F.col("was").isNull(), "only_in_replay").when(F.col("withheld").isNull(), "only_in_base").otherwise("both")
    change = F.when(F.col("was") & ~F.col("withheld"), F.concat(F.lit("recovered_"), grade(F.col("correct")))).when(~F.col("was") & F.col("withheld"), F.concat(F.lit("newly_refused_"), grade(F.col("was_correct")))).when(presence == "both", "same")
    return joined.select("run_id", presence.alias("presence"), change.alias("change"))


def replay_bucket(against_logged: bool = True) -> Column:
    """Where a replayed run belongs: columns error, base_error, drift, refused_then, refused_now, checks_then, checks_now, messages_then,
    messages_now, correct. Null checks or messages of then are not compared. A change on a run whose tool results drifted has a bucket of
    its own against the logged verdict; against a base both sides have seen the same sources."""
    differ = lambda c: F.col(f"{c}_then").isNotNull() & ~F.col(f"{c}_then").eqNullSafe(F.col(f"{c}_now"))
    then, now = F.col("refused_then"), F.col("refused_now")
    grade = F.when(F.col("correct").isNull(), "ungraded").when(F.col("correct"), "correct").otherwise("wrong")
    same_error = F.col("error").eqNullSafe(F.col("base_error")) if not against_logged else F.lit(False)
    failed = F.col("error").isNotNull() | (F.lit(False) if against_logged else F.col("base_error").isNotNull())
    changed = (then != now) | (then & differ("checks")) | differ("messages")
    return (
        F.when(failed & same_error, "errored_unchanged").when(failed, "errored").when(~changed, "same").when(F.lit(against_logged) & F.col("drift"), "drifted_change")
        .when(then & ~now, F.concat(F.lit("recovered_"), grade)).when(now & ~then, F.concat(F.lit("newly_refused_"), grade)).otherwise("check_change")
    )


def replay_summary(records: DataFrame, against_logged: bool = True) -> DataFrame:
    """(bucket, runs, drifted): how many runs each bucket holds and how many of these saw other tool results."""
    return records.groupBy(replay_bucket(against_logged).alias("bucket")).agg(F.count("*").alias("runs"), F.count_if(F.coalesce("drift", F.lit(False))).alias("drifted"))


def grade_change() -> Column:
    """Kind of a changed grade of the same text (was_correct, correct, drift, refused_now), or null; drift explains it before a refusal does."""
    both = F.col("was_correct").isNotNull() & F.col("correct").isNotNull() & (F.col("was_correct") != F.col("correct"))
    return F.when(both, F.when(F.col("drift"), "tool_drift").when(F.col("refused_now"), "refused").when(F.col("correct"), "now_correct").otherwise("now_wrong"))
