"""Checks of a question file: findings (id, check, level, message) from several queries in one union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numeric import band_buckets, category, normalised, printed_figure_match, tolerance, tolerance_bucket

TYPES = ("numeric", "comparison", "judged", "text", "refusal", "clarify")
#: Fields that only some types may have.
ONLY = {
    "expected_value": ("numeric",), "expected": ("comparison",), "accepted": ("numeric", "comparison", "text"), "refusal_kind": ("refusal",),
    "absence_terms": ("refusal",), "derivation": ("numeric",), "xbrl_source": ("numeric",),
}


def tickers_of(ticker: Column, tickers: Column) -> Column:
    """Sorted union of a question's one ticker and its list."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(ticker), F.coalesce(tickers, F.array().cast("array<string>"))))))


def single_ticker(ticker: Column, tickers: Column) -> Column:
    every = tickers_of(ticker, tickers)
    return F.when(F.size(every) == 1, every[0])


def gold_parts(questions: DataFrame) -> DataFrame:
    """(id, part, ticker): the value of a numeric question, or one part per label of a comparison, whose ticker is the label up to '-'."""
    numeric = questions.where("type = 'numeric'").select("id", F.lit("value").alias("part"), "ticker")
    labels = questions.where("type = 'comparison'").select("id", F.explode("expected").alias("e"))
    return numeric.unionByName(labels.select("id", F.col("e.label").alias("part"), F.split_part("e.label", F.lit("-"), F.lit(1)).alias("ticker")))


def _finding(df: DataFrame, check: str, level: str, message: Column) -> DataFrame:
    return df.select("id", F.lit(check).alias("check"), F.lit(level).alias("level"), message.alias("message"))


def bands_overlap(a: Column, unit_a: Column, b: Column, unit_b: Column) -> Column:
    x, y = normalised(a, unit_a), normalised(b, unit_b)
    return (category(unit_a) == category(unit_b)) & (F.abs(x - y) <= tolerance(x) + tolerance(y))


def check_questions(questions: DataFrame, companies: DataFrame, gold: DataFrame, others: DataFrame) -> DataFrame:
    """Findings on questions (id, type, ticker, tickers, expected_value, expected_unit, expected, accepted, refusal_kind, traps).

    Columns absence_terms, derivation, xbrl_source (tag, accession, end) and a trap's ticker are checked where they are there.
    companies (ticker); gold (id, part, ticker, anchor, found: chunks that hold the anchor); others (id): ids of other files.
    """
    q = questions
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    found = [
        _finding(q.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_id", "error", text("id stands in ", F.col("n"), " rows")),
        _finding(q.where(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))), "unknown_type", "error", text("type ", F.col("type"))),
        _finding(q.join(others.select("id").distinct(), "id", "left_semi"), "id_collision", "error", F.lit("id is used in another file")),
    ]
    for name, types in ONLY.items():
        if name not in q.columns:
            continue
        found.append(_finding(q.where(F.col(name).isNotNull() & ~F.col("type").isin(*types)), "field_of_other_type", "error", text(f"{name} on type ", F.col("type"))))
    named = q.select("id", F.explode(tickers_of(F.col("ticker"), F.col("tickers"))).alias("named"))
    found.append(_finding(named.join(companies, F.col("named") == companies["ticker"], "left_anti"), "unknown_ticker", "error", text("ticker ", F.col("named"))))
    entries = q.where("expected is not null").select("id", tickers_of(F.col("ticker"), F.col("tickers")).alias("all"), F.explode("expected").alias("e"))
    outside = entries.where(F.size(F.array_except(F.coalesce("e.companies", F.array().cast("array<string>")), "all")) > 0)
    found.append(_finding(outside, "entry_company", "error", text("entry ", F.col("e.label"), " names a company that the question does not")))
    traps = q.where("traps is not null and expected_value is not null").select("id", "expected_value", "expected_unit", F.explode("traps").alias("t"))
    found.append(_finding(traps.where(bands_overlap(F.col("t.value"), F.col("t.unit"), F.col("expected_value"), F.col("expected_unit"))), "trap_overlaps_answer", "error", text("trap ", F.col("t.value"))))
    several = single_ticker(F.col("ticker"), F.col("tickers")).isNull()
    if "ticker" in q.schema["traps"].dataType.elementType.names:
        unnamed = q.where(several & F.exists("traps", lambda t: t["ticker"].isNull()))
        found.append(_finding(unnamed, "trap_without_ticker", "error", F.lit("a trap names no ticker, and the question has no single one")))
    if "xbrl_source" in q.columns:
        sourced = q.where("xbrl_source is not null")
        found.append(_finding(sourced.where(several), "xbrl_source", "error", F.lit("the question names several companies, so whose facts to read is unclear")))
        found.append(_finding(sourced.where("expected_unit = 'percent'"), "xbrl_source", "error", F.lit("a ratio is stored as a fraction, so a percent figure can't be checked")))
        if "derivation" in q.columns:
            found.append(_finding(sourced.where("derivation is not null"), "xbrl_source", "error", F.lit("a derivation is checked through its inputs, not one fact")))
    parts = gold_parts(q)
    anchored = gold.select("id", "part").distinct()
    found.append(_finding(parts.join(anchored, ["id", "part"], "left_anti"), "part_without_anchor", "error", text("part ", F.col("part"))))
    found.append(_finding(gold.where("found = 0"), "anchor_not_found", "error", text("anchor of ", F.col("part"))))
    found.append(_finding(gold.where("found > 1"), "anchor_in_several_chunks", "note", text("anchor of ", F.col("part"), " is in ", F.col("found"), " chunks")))
    return reduce(DataFrame.unionByName, found)


def facts_of_figures(figures: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that print as a figure (id, accession, value, decimals): same filing, within half a unit of the last digit."""
    joined = figures.join(facts.select("accn", "taxonomy", "tag", "unit", "start", "end", "val"), F.col("accession") == F.col("accn"))
    return joined.where(printed_figure_match(F.col("val"), F.col("value"), F.col("decimals"))).select("id", "taxonomy", "tag", "unit", "start", "end", "val")


def check_source_facts(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings on figures that one fact alone verifies: questions (id, value, decimals, xbrl_source: tag, accession, end), facts (accn, tag, end, val).

    The source filing's fact must print as the figure; other filings that report the same tag and day otherwise are warned of.
    """
    asked = questions.select("id", "value", "decimals", "xbrl_source.*")
    own = facts.select(F.col("accn"), F.col("tag").alias("_tag"), F.col("end").alias("_end"), "val")
    joined = asked.join(own, (F.col("tag") == F.col("_tag")) & (F.col("end") == F.col("_end"))).withColumn("fits", printed_figure_match(F.col("val"), F.col("value"), F.col("decimals")))
    source = joined.where("accn = accession").groupBy("id").agg(F.bool_or("fits").alias("fits"), F.array_join(F.array_sort(F.collect_set(F.col("val").cast("string"))), ", ").alias("vals"))
    told = asked.join(source, "id", "left")
    missing = _finding(told.where("fits is null"), "xbrl_source", "error", F.concat(F.lit("no fact of "), F.col("tag"), F.lit(" in "), F.col("accession")))
    wrong = _finding(told.where("not fits"), "xbrl_source", "error", F.concat(F.col("tag"), F.lit(" in "), F.col("accession"), F.lit(" is "), F.col("vals")))
    others = joined.where("accn <> accession and not fits").join(source.where("fits").select("id"), "id", "left_semi")
    return missing.unionByName(wrong).unionByName(_finding(others, "xbrl_source", "warning", F.concat(F.lit("another filing reports "), F.col("val").cast("string"), F.lit(": "), F.col("accn"))))


def traps_beside_answer(questions: DataFrame, gold: DataFrame, figures: DataFrame) -> DataFrame:
    """Findings on traps that a gold chunk of the trap's company prints: questions (id, ticker, tickers, traps: value, unit, ticker), gold (id, doc_id,
    ticker: the chunk's), figures (doc_id, value, unit) of the chunks."""
    own = F.coalesce("t.ticker", single_ticker(F.col("ticker"), F.col("tickers")))
    traps = questions.select("id", F.explode("traps").alias("t"), "ticker", "tickers").select("id", own.alias("_own"), "t.value", "t.unit")
    norm = normalised(F.col("value"), F.col("unit"))
    asked = traps.withColumns({"category": category(F.col("unit")), "_n": norm}).withColumn("_bucket", F.explode(band_buckets(F.col("_n"), tolerance(F.col("_n")))))
    have = figures.select("doc_id", category(F.col("unit")).alias("category"), norm.alias("_found")).distinct().withColumn("_bucket", tolerance_bucket(F.col("_found")))
    chunks = gold.select("id", "doc_id", F.col("ticker").alias("_own")).distinct()
    beside = asked.join(chunks, ["id", "_own"]).join(have, ["doc_id", "category", "_bucket"]).where(F.abs(F.col("_found") - F.col("_n")) <= tolerance(F.col("_n")))
    first = beside.groupBy("id", "value").agg(F.min("doc_id").alias("doc_id"))
    return _finding(first, "trap_beside_answer", "warning", F.concat(F.lit("trap "), F.col("value").cast("string"), F.lit(" is printed in gold chunk "), F.col("doc_id").cast("string")))
