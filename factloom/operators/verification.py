"""Verification of answers: each claim against the source it cites, and each number of the answer against the claims.

claims (answer_id, claim_no, citation_index, value, unit, quote); results (answer_id, idx, text, header); answers (answer_id,
question, answer_text). Claims join their sources by answer and index; numbers are exploded and matched per answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers, text
from factloom.functions.numeric import CLAIM_UNITS, band_buckets, category, normalised, num_match, tolerance, tolerance_bucket
from factloom.operators.tables import cell_grounding

#: The window before a citation, values that percentage formulas bring along.
WINDOW = 150
IDENTITIES = {"percent_change": (1.0, -1.0, 100.0, -100.0), "percent_of": (100.0,)}
#: Buckets of the tolerance that operands and numbers are joined on together.
GROUPED = 16
#: Fixed pattern: dates, years, form names, notes and spans of time are no claims.
NON_CLAIM = (
    r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b|\b\d{4}-\d{2}-\d{2}\b"
    r"|\b(?:19|20)\d{2}\b|\b10-[KQ]s?\b|\bNote\s+\d+\b|\b\d+[\s-](?:year|month|day)s?\b"
)
#: Whatever ``NON_CLAIM`` matches holds one of these; it is cheap to see that most texts hold none.
MAYBE_NON_CLAIM = r"\d{4}|\d[\s-][A-Za-z]|[eE]\s+\d"
BRACKET = r"\[\d+(?:\s*,\s*\d+)*\]"


def without_non_claims(text: Column) -> Column:
    return F.when(text.rlike(MAYBE_NON_CLAIM), F.regexp_replace(text, NON_CLAIM, "")).otherwise(text)


def grounding_quote(quote: Column, index: Column, header: Column) -> Column:
    """The quote without an echo of its source's citation header, with or without the number."""
    bare = F.ltrim(quote)
    full = F.concat(F.lit("["), index.cast("string"), F.lit("] "), header)
    cut = lambda head: F.ltrim(bare.substr(F.length(head) + 1, F.length(bare)))
    return F.when(header.isNull(), quote).when(bare.startswith(full), cut(full)).when(bare.startswith(header), cut(header)).otherwise(quote)


def claim_verdicts(claims: DataFrame, results: DataFrame) -> DataFrame:
    """claims with ``check``: the first failing check, or null. A value in a table cell is judged by the table alone."""
    counts = results.groupBy("answer_id").agg(F.count("*").alias("_results"))
    source = results.select("answer_id", F.col("idx").alias("citation_index"), F.col("text").alias("_source"), F.col("header").alias("_header"))
    joined = claims.join(counts, "answer_id", "left").join(source, ["answer_id", "citation_index"], "left")
    joined = joined.withColumn("_quote", grounding_quote(F.col("quote"), F.col("citation_index"), F.col("_header")))
    joined = joined.withColumn("_cells", cell_grounding(F.col("value"), F.col("unit"), F.col("_quote"), F.col("_source"))).withColumn("_state", text.quote_state(F.col("_quote"), F.col("_source")))
    joined = joined.withColumn("_long", text.quote_is_long_enough(text.normalised_text(F.col("_quote")))).withColumn("_prose", text.quote_stands(F.col("_quote"), F.col("_source"), F.col("_state")))
    # a claim without a value, a unit or a source has failed before its quote is read for numbers
    asked = F.col("value").isNotNull() & F.col("unit").isNotNull() & F.col("_source").isNotNull()
    found = numbers.number_candidates(numbers.numbers_in(F.when(asked, F.col("_quote"))), numbers.caption_units(F.col("_source")))
    norm = normalised(F.col("value"), F.col("unit"))
    stated = F.exists(found, lambda n: num_match(category(n["unit"]), normalised(n["value"], n["unit"]), category(F.col("unit")), norm))
    numeric = F.col("value").isNotNull()
    grounded = F.when(numeric & (F.col("_cells.cells") > 0), F.col("_cells.grounded")).otherwise(F.col("_prose"))
    check = (
        F.when((F.col("citation_index") < 1) | (F.col("citation_index") > F.coalesce("_results", F.lit(0))), "citation_out_of_range")
        .when(numeric != F.col("unit").isNotNull(), "malformed_claim").when(~F.col("_long"), "quote_too_short")
        .when(~grounded & numeric, "quote_not_found").when(~grounded, "qualitative_quote_not_found").when(numeric & ~stated, "value_not_in_quote")
    )
    return joined.withColumn("check", check).drop("_results", "_source", "_header", "_quote", "_cells", "_state", "_long", "_prose")


def source_numbers(results: DataFrame) -> DataFrame:
    """(answer_id, idx, value, unit): the numbers that results (answer_id, idx, text) hold, captions' units included."""
    found = results.select("answer_id", "idx", F.explode(numbers.number_candidates(numbers.numbers_in(F.col("text")), numbers.caption_units(F.col("text")))).alias("n"))
    return found.select("answer_id", "idx", F.col("n.value").alias("value"), F.col("n.unit").alias("unit"))


def _group(norm: Column) -> Column:
    return F.floor(tolerance_bucket(norm) / GROUPED)


def unit_trials(operands: DataFrame) -> DataFrame:
    """Each operand in each unit, with the group of buckets that numbers within its band lie in; twice where the band spans two."""
    units = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(u).alias("name")) for i, u in enumerate(CLAIM_UNITS)]))
    norm = normalised(F.col("value"), F.col("_try.name"))
    trials = operands.withColumn("_try", units).select("answer_id", "operand", "citation_index", F.col("_try.no").alias("_no"), (F.col("_try.name") == F.col("unit")).alias("_own"), category(F.col("_try.name")).alias("_category"), norm.alias("_norm"))
    ends = [_group(F.col("_norm") + s * tolerance(F.col("_norm"))) for s in (-1, 1)]
    return trials.withColumn("_bucket", F.explode(F.sequence(*ends)))


def operand_grounding(operands: DataFrame, counts: DataFrame, found: DataFrame) -> DataFrame:
    """(answer_id, operand, outcome, other_unit, other_index) of the operands of calculations.

    operands (answer_id, operand, value, unit, citation_index); counts (answer_id, n_results); found: numbers of results as
    ``source_numbers`` gives them. The outcome is bad_index, ok, wrong_unit (the first other unit under which the cited result
    holds the value), wrong_index (the first other result that holds it) or ungroundable. Every operand is tried in each unit;
    trials meet numbers in an equi-join on ``GROUPED`` buckets of the tolerance, so no answer's numbers are all paired with all
    operands, and few trials lie in more than one group: what is shuffled is little more than a narrow row for each unit.
    """
    trials = unit_trials(operands)
    have = found.select("answer_id", "idx", category(F.col("unit")).alias("_category"), normalised(F.col("value"), F.col("unit")).alias("_found")).withColumn("_bucket", _group(F.col("_found")))
    have = have.repartition("answer_id", "_category", "_bucket").distinct()  # dealt once, for the join
    own, cited = F.col("_own"), F.col("idx") == F.col("citation_index")
    hits = trials.join(have, ["answer_id", "_category", "_bucket"]).where((F.abs(F.col("_found") - F.col("_norm")) <= tolerance(F.col("_norm"))) & (own | cited))
    by_operand = hits.groupBy("answer_id", "operand").agg(
        F.max(own & cited).alias("_ok"), F.min(F.when(~own & cited, F.col("_no"))).alias("_unit"), F.min(F.when(own & ~cited, F.col("idx"))).alias("_index"),
    )
    joined = operands.join(counts, "answer_id", "left").join(by_operand, ["answer_id", "operand"], "left")
    outside = (F.col("citation_index") < 1) | (F.col("citation_index") > F.coalesce("n_results", F.lit(0)))
    outcome = F.when(outside, "bad_index").when(F.col("_ok"), "ok").when(F.col("_unit").isNotNull(), "wrong_unit").when(F.col("_index").isNotNull(), "wrong_index").otherwise("ungroundable")
    judged = joined.withColumn("outcome", outcome)
    return judged.select("answer_id", "operand", "outcome", F.when(F.col("outcome") == "wrong_unit", F.element_at(F.array(*map(F.lit, CLAIM_UNITS)), F.col("_unit") + 1)).alias("other_unit"), F.when(F.col("outcome") == "wrong_index", F.col("_index")).alias("other_index"))


def nearest(rows: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """``rows`` (answer_id, _percent, _at, ...) with ``_<kind>_below`` and ``_<kind>_above``: the nearest ``_at`` of each kind of rows at or
    below and above a row of no kind, within its answer and category. Rows dealt by answer are sorted up and down and meet in no join."""
    other = F.coalesce(F.greatest(*(of.cast("int") for of in kinds.values()), F.lit(0)), F.lit(0)) == 0  # equal numbers come before these
    own = Window.partitionBy("answer_id", "_percent").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for way, order in (("below", F.asc("_at")), ("above", F.desc("_at"))):
        rows = rows.withColumns({f"_{kind}_{way}": F.last(F.when(of, F.col("_at")), ignorenulls=True).over(own.orderBy(order, other)) for kind, of in kinds.items()})
    return rows


def is_near(kind: str, band: Column) -> Column:
    """Whether a row of ``nearest`` has a number of a kind within ``band``."""
    return F.coalesce(F.least(*(F.abs(F.col(f"_{kind}_{way}") - F.col("_at")) for way in ("below", "above"))) <= band, F.lit(False))


def uncovered_numbers(answers: DataFrame, claims: DataFrame, results: DataFrame) -> DataFrame:
    """(answer_id, category, norm): numbers of the answer that no claim, no number of the question, no operand of a finished
    calculation and no identity of its formula covers. A number negative by parentheses alone may match either sign."""
    plain = lambda c: without_non_claims(F.regexp_replace(c, BRACKET, ""))
    pair = lambda v, u: (category(u).alias("category"), normalised(v, u).alias("norm"))
    stated = answers.select("answer_id", F.explode(numbers.numbers_in(plain(F.col("answer_text")))).alias("n"))
    stated = stated.select("answer_id", "n.unit", "n.value", F.col("n.paren").alias("paren"), *pair(F.col("n.value"), F.col("n.unit")))
    claimed = claims.where("value is not null and unit is not null").select("answer_id", *pair(F.col("value"), F.col("unit")))
    asked = answers.select("answer_id", F.explode(numbers.numbers_in(without_non_claims(F.col("question")))).alias("n")).select("answer_id", *pair(F.col("n.value"), F.col("n.unit")))
    operations = results.where("chunk_index = 'calculated'").withColumn("_left", F.regexp_replace(F.substring_index("text", "=", 1), BRACKET, ""))
    operands = operations.select("answer_id", F.explode(numbers.number_candidates(numbers.numbers_in(F.col("_left")), numbers.caption_units(F.col("_left")))).alias("n"))
    operands = operands.select("answer_id", *pair(F.col("n.value"), F.col("n.unit")))
    known = claimed.unionByName(asked).unionByName(operands)
    identity = F.when(F.col("_left").rlike("percent change|change from"), F.array(*map(F.lit, IDENTITIES["percent_change"]))).when(F.col("_left").contains("percent of"), F.array(*map(F.lit, IDENTITIES["percent_of"])))
    identities = operations.select("answer_id", F.explode(identity).alias("value")).distinct()
    left = stated.join(identities.withColumn("unit", F.lit("raw")), ["answer_id", "unit", "value"], "left_anti")
    left = left.withColumn("_sign", F.explode(F.when(F.col("paren"), F.array(F.lit(1.0), F.lit(-1.0))).otherwise(F.array(F.lit(1.0)))))
    percent = (F.col("category") == "percent").alias("_percent")
    rows = left.select("answer_id", percent, (F.col("norm") * F.col("_sign")).alias("_at"), F.col("norm").alias("_norm"))
    rows = rows.unionByName(known.where("answer_id is not null").select("answer_id", percent, F.col("norm").alias("_at"), F.lit(None).cast("double").alias("_norm")))
    near = nearest(rows.repartition("answer_id"), {"known": F.col("_norm").isNull()}).where("_norm is not null")
    covered = is_near("known", F.greatest(F.abs("_norm") * 0.01, F.lit(0.05)))
    out = near.groupBy("answer_id", "_percent", F.col("_norm").alias("norm")).agg(F.bool_or(covered).alias("covered")).where("not covered")
    return out.select("answer_id", F.when(F.col("_percent"), "percent").otherwise("scale").alias("category"), "norm")


def gate(answers: DataFrame, claims: DataFrame, results: DataFrame) -> DataFrame:
    """(answer_id, warnings, withheld): warnings of both passes counted by check; an answer with any is withheld, and so is one
    without a structured submission (column ``structured``)."""
    failed = claim_verdicts(claims, results).select("answer_id", "check")  # no filter on it: Spark would push it down and judge each claim twice
    loose = uncovered_numbers(answers, claims, results).select("answer_id", F.lit("uncovered_number").alias("check"))
    shape = answers.where("not structured").select("answer_id", F.lit("no_structured_answer").alias("check"))
    counts = failed.unionByName(loose).unionByName(shape).groupBy("answer_id", "check").agg(F.count("*").alias("n"))
    found = counts.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.when(F.col("check").isNotNull(), F.struct("check", "n")))).alias("found"))
    by_answer = found.select("answer_id", F.when(F.size("found") > 0, F.map_from_entries("found")).alias("warnings"))
    return answers.select("answer_id").join(by_answer, "answer_id", "left").withColumn("withheld", F.col("warnings").isNotNull())


def citation_claims(answers: DataFrame) -> DataFrame:
    """(answer_id, citation_index, value, unit): numbers in the window before each citation mark, back to the mark before it."""
    marks = F.regexp_extract_all(F.col("answer_text"), F.lit(BRACKET), F.lit(0))
    texts = F.split(F.col("answer_text"), BRACKET, -1)
    pairs = F.zip_with(marks, texts, lambda mark, text: F.struct(mark.alias("mark"), F.right(text, F.lit(WINDOW)).alias("window")))  # there is a text more than marks
    windows = answers.select("answer_id", F.explode(pairs).alias("w")).select("answer_id", "w.mark", "w.window").where("mark is not null")
    found = windows.withColumn("n", F.explode(numbers.numbers_in(without_non_claims(F.col("window")))))
    each = F.explode(F.regexp_extract_all("mark", F.lit(r"\d+"), F.lit(0))).alias("citation_index")
    out = found.select("answer_id", each, F.col("n.value").alias("value"), F.col("n.unit").alias("unit"))
    return out.withColumn("citation_index", F.col("citation_index").cast("int"))


def judged_citations(answers: DataFrame, results: DataFrame) -> DataFrame:
    """(answer_id, category, norm, ok) of the numbers before citation marks: whether the cited result holds the number. Results are read
    for numbers before they meet citations, so that these and no texts are shuffled, and each result is read once."""
    sources = numbers.number_candidates(numbers.numbers_in(F.col("text")), numbers.caption_units(F.col("text")))
    said = results.select("answer_id", F.col("idx").alias("citation_index"), F.transform(sources, lambda n: F.struct(category(n["unit"]).alias("category"), normalised(n["value"], n["unit"]).alias("norm"))).alias("_said"))
    cited = citation_claims(answers).join(said, ["answer_id", "citation_index"])
    own = normalised(F.col("value"), F.col("unit"))
    cited = cited.withColumn("ok", F.exists("_said", lambda n: num_match(n["category"], n["norm"], category(F.col("unit")), own)))
    return cited.select("answer_id", category(F.col("unit")).alias("category"), own.alias("norm"), "ok")


def citation_verified(expected: DataFrame, answers: DataFrame, results: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(answer_id, value, unit, verified) of expected values: true unless every citation attached to the value fails."""
    cited = judged_citations(answers, results)
    asked = expected.select("answer_id", "value", "unit", category(F.col("unit")).alias("category"), normalised(F.col("value"), F.col("unit")).alias("target"))
    band = F.greatest(F.abs("target") * tolerance, F.lit(0.05))
    tried = asked.withColumn("_bucket", F.explode(band_buckets(F.col("target"), band)))
    near = tried.join(cited.withColumn("_bucket", tolerance_bucket(F.col("norm"))), ["answer_id", "category", "_bucket"]).where(F.abs(F.col("norm") - F.col("target")) <= band)
    near = near.groupBy("answer_id", "value", "unit").agg(F.max("ok").alias("_ok"))
    return asked.select("answer_id", "value", "unit").distinct().join(near, ["answer_id", "value", "unit"], "left").select("answer_id", "value", "unit", F.coalesce("_ok", F.lit(True)).alias("verified"))
