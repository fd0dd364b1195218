"""Reports of runs: which questions they take, what they may be compared with, and how their records are shown."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.batch import batch_function

#: The fields that a replayed call of each tool is compared in, and the questions of a report that names none.
OBSERVED = {"search_filings": ("result_count",), "get_financial_fact": ("found", "value"), "calculate": ("found", "value"), "compare_financial_metric": ("found", "companies")}
DEFAULT_QUESTIONS = "eval/eval_questions.jsonl"


def select_questions(questions: DataFrame, ids: list[str] | None = None, with_skipped: bool = False) -> DataFrame:
    """Questions (id, skip, ...) of a run: the named ids, skipped or not, else all that are not skipped. An unknown id is an
    error. ``ids`` is what a caller typed; the questions stay distributed and keep their columns, hence their file order."""
    if ids is None:
        return questions if with_skipped else questions.where(~F.coalesce("skip", F.lit(False)))
    wanted = questions.where(F.col("id").isin(*ids)) if ids else questions.limit(0)
    unknown = sorted(set(ids) - {r.id for r in wanted.select("id").distinct().collect()})
    if unknown:
        raise ValueError(f"no question has the id {', '.join(unknown)}")
    return wanted


def observed_differences(calls: DataFrame) -> DataFrame:
    """(run_id, ord, tool, field, logged, replayed) of calls whose replay gave another value in a field of its tool.

    calls (run_id, ord, tool, logged, replayed), outputs as variants. Absent equals null. A tool without a route has one row
    with the field ``no_route``, so that none passes unseen.
    """
    fields = F.create_map(*[x for tool, names in OBSERVED.items() for x in (F.lit(tool), F.array(*map(F.lit, names)))])
    each = calls.withColumn("field", F.explode(F.coalesce(F.try_element_at(fields, F.col("tool")), F.array(F.lit("no_route")))))
    take = lambda side: F.nullif(F.to_json(F.try_variant_get(side, "$", "map<string,variant>")[F.col("field")]), F.lit("null"))
    compared = each.withColumns({"logged": take("logged"), "replayed": take("replayed")})
    return compared.where((F.col("field") == "no_route") | ~F.col("logged").eqNullSafe(F.col("replayed"))).select("run_id", "ord", "tool", "field", "logged", "replayed")


def base_verdict(base: DataFrame, current: DataFrame) -> DataFrame:
    """(report, refused, notes): may a report be compared with the base of the same name?

    base and current (report, gold_sha, corpus_sha, index_matches). Another gold file refuses; a corpus that differs or is not
    known, and an index that is stale, only add notes.
    """
    b, c = (lambda name: F.col(f"b.{name}")), (lambda name: F.col(f"c.{name}"))
    unknown = lambda sha: F.coalesce(sha == "", F.lit(True))
    notes = F.array_compact(F.array(
        F.when(unknown(c("corpus_sha")), "corpus_unknown"),
        F.when(unknown(b("corpus_sha")), "base_corpus_unknown").when(~unknown(c("corpus_sha")) & (b("corpus_sha") != c("corpus_sha")), "corpus_differs"),
        F.when(~b("index_matches"), "base_index_stale"), F.when(~c("index_matches"), "index_stale"),
    ))
    joined = current.alias("c").join(base.alias("b"), F.col("b.report") == F.col("c.report"))
    return joined.select(c("report").alias("report"), (~b("gold_sha").eqNullSafe(c("gold_sha"))).alias("refused"), notes.alias("notes"))


def provenance(corpus: DataFrame, sidecar: DataFrame | None) -> DataFrame:
    """One row (corpus_sha, index_matches): whether the index was built from the corpus (files, sha). Null if there is no sidecar,
    if it holds no digest, or if the corpus could not be read."""
    if sidecar is None:
        return corpus.select(F.col("sha").alias("corpus_sha"), F.lit(None).cast("boolean").alias("index_matches"))
    stored = sidecar.agg(F.max("sha").alias("stored"))  # one row
    return corpus.crossJoin(F.broadcast(stored)).select(F.col("sha").alias("corpus_sha"), (F.col("sha") == F.col("stored")).alias("index_matches"))


def questions_path(report: Column) -> Column:
    """Path of the questions that a report (variant) names, or the default."""
    return F.coalesce(F.nullif(F.try_variant_get(report, "$.provenance.config.questions.path", "string"), F.lit("")), F.lit(DEFAULT_QUESTIONS))


def fact_source(ticker: Column, period_end: Column, accession: Column, form: Column, filed: Column, url: Column) -> Column:
    """Source block of a fact as JSON text: form, filed and sec_url stand in it only where they are known."""
    named = {"ticker": ticker, "period_end": period_end, "accession": accession, "form": form, "filed": filed, "sec_url": url}
    return F.to_json(F.struct(*[c.alias(name) for name, c in named.items()]))


#: Control characters as escapes; the others outside of ASCII are written so by the codec.
_CONTROLS = {c: f"\\x{c:02x}" for c in (*range(32), 127)} | {9: r"\t", 10: r"\n", 13: r"\r"}


@batch_function("string")
def _printable(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.translate(_CONTROLS).encode("ascii", "backslashreplace").decode("ascii"))


def printable(text: Column) -> Column:
    """The text with every character outside of printable ASCII written as an escape, so that no text controls a terminal. Texts that
    are printable as they are never leave the JVM."""
    return F.when(text.rlike("^[ -~]*$"), text).otherwise(_printable(text))


def clipped(json: Column, n: int) -> Column:
    """JSON text of at most n characters; a longer one is cut there and ends in three dots."""
    return F.when(F.length(json) > n, F.concat(F.substring(json, 1, n), F.lit("..."))).otherwise(json)


def confidence_label(z: float) -> str:
    """Name of a two-sided interval: the normal distribution's mass within z standard deviations."""
    return f"{math.erf(z / math.sqrt(2)):.0%} CI"
