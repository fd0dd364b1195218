"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are summed over cells of source, language and topic. Raking multiplies the cells' weights, margin by margin, until
the weights of every source, language and topic meet their targets within ``TOLERANCE`` (or ``MAX_ROUNDS`` are over: targets
that empty cells make impossible have no solution, and ``_mix_gap`` tells the largest relative error left); a cell's ratio of weight to tokens, times one scale,
is the probability with which its documents are sampled. The scale is calibrated so that the expected tokens meet the
budget although no probability exceeds 1. A document is kept if a number drawn from the hash of its doc_id is below its
probability, so any rerun and any partitioning keep the same documents.

Targets: by default each margin's shares are flattened with ``temperature`` (share ** temperature), which gives small
sources more weight; explicit targets may be given as {column: {value: share}}; values without a target keep their share
of what is left.

Scale: documents are summed with map-side aggregation; raking works on the cell table, whose size does not depend on the
number of documents; the cells are joined back by a broadcast if they are few (they are counted) and by a shuffle otherwise.

Nulls and edge cases: a null source or language is a value of its own; a null or empty text has no tokens; a cell without
tokens has ratio 1; repeated rows of a doc_id are kept or dropped together, as are all rows without one; an empty table gives an empty result; columns of
``docs`` pass through, and internal columns have names that start with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, small_side

TEMPERATURE = 0.7
BUDGET = 0.75
#: Largest relative error of a margin, and of the expected tokens against the budget.
TOLERANCE = 1e-12
#: Rounds of raking between two looks at the error, and at most.
ROUNDS = 6
MAX_ROUNDS = 240
MAX_SCALE_ROUNDS = 200
#: Rounds that the SQL twin writes out; both are at the same fixed point by then.
SQL_ROUNDS = 90
SQL_SCALE_ROUNDS = 60
SEED = "mix-1"
DIMENSIONS = ("source", "lang", "topic")
#: Topics by the first pattern that a text matches.
TOPICS = (
    ("legal", r"[Ll]icen[cs]e|[Rr]ights reserved|[Cc]opyright"),
    ("contact", r"@[A-Za-z0-9-]+[.]|[+][0-9]"),
    ("tabular", r"[|].*[|]"),
    ("numeric", r"[0-9]{3}"),
)


def token_count(text: Column) -> Column:
    """Words of a text, told by its blanks, tabs and line ends."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1).cast("long")


def topic_of(text: Column) -> Column:
    rule = F.when(F.coalesce(text, F.lit("")) == "", "empty")
    for name, pattern in TOPICS:
        rule = rule.when(text.rlike(pattern), name)
    return rule.otherwise("prose")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) drawn from the md5 of seed and doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def _target_column(dimension: str, given: dict[str, float], untargeted: float, temperature: float) -> Column:
    """Share that a value of the dimension shall have, from its tokens ``_mix_of`` and the total ``_mix_all``."""
    if not given:
        return F.pow(F.col("_mix_of") / F.col("_mix_all"), F.lit(temperature))
    rest = max(0.0, 1 - sum(given.values()))
    entry = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
    return F.coalesce(F.element_at(entry, F.col(f"_mix_{dimension}")), F.lit(rest / max(untargeted, 1.0)) * F.col("_mix_of"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], temperature: float, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """Cells with column ``_mix_w``, weights whose margins meet the targets (sum of all: the sum of ``_mix_tokens``), and the largest relative error left."""
    total = cells.agg(F.sum("_mix_tokens")).first()[0] or 0
    cells = cells.withColumn("_mix_all", F.lit(float(max(total, 1))))
    for d in DIMENSIONS:
        of = cells.groupBy(f"_mix_{d}").agg(F.sum("_mix_tokens").cast("double").alias("_mix_of"))
        given = targets.get(d) or {}
        untargeted = of.where(~F.col(f"_mix_{d}").isin(list(given))).agg(F.sum("_mix_of")).first()[0] or 0.0 if given else 0.0
        share = of.withColumn("_mix_all", F.lit(float(max(total, 1)))).withColumn("_mix_t", _target_column(d, given, untargeted, temperature))
        norm = share.agg(F.sum(F.when(F.col("_mix_of") > 0, F.col("_mix_t")))).first()[0] or 1.0
        share = share.select(f"_mix_{d}", (F.col("_mix_t") / F.lit(float(norm)) * F.col("_mix_all")).alias(f"_mix_t_{d}"))
        cells = cells.join(share, f"_mix_{d}")
    cells = checkpoint(cells.withColumn("_mix_w", F.col("_mix_tokens").cast("double")))
    gap = margin_gap(cells)
    for start in range(0, rounds, ROUNDS):
        if gap <= tolerance:
            break
        for _ in range(min(ROUNDS, rounds - start)):
            for d in DIMENSIONS:
                margin = F.sum("_mix_w").over(Window.partitionBy(f"_mix_{d}"))
                cells = cells.withColumn("_mix_w", F.when(margin > 0, F.col("_mix_w") * F.col(f"_mix_t_{d}") / margin).otherwise(0.0))
        cells = checkpoint(cells)
        gap = margin_gap(cells)
    return cells, gap


def margin_gap(cells: DataFrame) -> float:
    """Largest error of a margin against its target, relative to the target."""
    gaps = []
    for d in DIMENSIONS:
        margins = cells.groupBy(f"_mix_{d}").agg(F.sum("_mix_w").alias("w"), F.first(f"_mix_t_{d}").alias("t")).where("t > 0")
        gaps.append(margins.agg(F.max(F.abs(F.col("w") / F.col("t") - 1)).alias("gap")))
    return gaps[0].unionByName(gaps[1]).unionByName(gaps[2]).agg(F.max("gap")).first()[0] or 0.0


def tagged(docs: DataFrame) -> DataFrame:
    """``docs`` with the values of its dimensions and its tokens (_mix_n)."""
    none = F.lit("(none)")
    return docs.withColumns({
        "_mix_source": F.coalesce(docs["source"].cast("string"), none),
        "_mix_lang": F.coalesce(docs["lang"].cast("string"), none),
        "_mix_topic": topic_of(docs["text"]),
        "_mix_n": token_count(docs["text"]),
    })


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, rounds: int = MAX_ROUNDS, seed: str = SEED) -> DataFrame:
    """``docs`` with _mix_topic, _mix_n (tokens), _mix_p (probability), _mix_kept and _mix_gap (error that raking left)."""
    return sampled(tagged(docs), targets, budget, temperature, rounds, seed)


def sampled(marked: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, rounds: int = MAX_ROUNDS, seed: str = SEED) -> DataFrame:
    """``mixed`` for documents that are tagged already."""
    names = [f"_mix_{d}" for d in DIMENSIONS]
    cells = checkpoint(marked.groupBy(*names).agg(F.sum("_mix_n").alias("_mix_tokens")))
    raked, gap = rake(cells, targets or {}, temperature, rounds)
    raked = raked.withColumn("_mix_r", F.when(F.col("_mix_tokens") > 0, F.col("_mix_w") / F.col("_mix_tokens")).otherwise(1.0))
    total, count = raked.agg(F.sum("_mix_tokens").cast("double"), F.count("*")).first()
    scale = budget
    for _ in range(MAX_SCALE_ROUNDS):
        got = raked.agg(F.sum(F.col("_mix_tokens") * F.least(F.lit(1.0), F.lit(scale) * F.col("_mix_r")))).first()[0]
        if not got or abs(got - budget * total) <= TOLERANCE * total:
            break
        scale = scale * budget * total / got
    chance = raked.select(*names, F.least(F.lit(1.0), F.lit(float(scale)) * F.col("_mix_r")).alias("_mix_p"))
    kept = uniform(F.col("doc_id"), seed) < F.col("_mix_p")
    return marked.join(small_side(chance, count, 50_000), names).withColumns({"_mix_kept": kept, "_mix_gap": F.lit(float(gap))})


def mixing_query(docs: DataFrame) -> DataFrame:
    slim = checkpoint(tagged(docs.select("doc_id", "source", "lang", "text")).drop("text"))  # texts are scanned once
    return sampled(slim).select(
        "doc_id", "source", "lang", F.col("_mix_topic").alias("topic"), F.col("_mix_n").alias("n_tokens"),
        (F.floor(F.col("_mix_p") * 1e6 + 0.5) / 1e6).alias("probability"), F.col("_mix_kept").alias("kept"),
    )


def mixing_sql(docs: str = "documents", budget: float = BUDGET, temperature: float = TEMPERATURE) -> str:
    """DuckDB SQL of ``mixing_query``; raking and calibration are written out round by round."""
    topic = "CASE WHEN coalesce(text, '') = '' THEN 'empty' " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    parts = [
        f"marked AS (SELECT doc_id, source, lang, coalesce(source, '(none)') AS d_source, coalesce(lang, '(none)') AS d_lang, {topic} AS d_topic, "
        f"CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(translate(text, ' ' || chr(10) || chr(9), '')) + 1 END AS n FROM {docs})",
        "cells AS (SELECT d_source, d_lang, d_topic, sum(n)::DOUBLE AS tokens FROM marked GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        parts.append(f"o_{d} AS (SELECT d_{d}, sum(tokens) AS o FROM cells GROUP BY 1)")
        parts.append(f"t_{d} AS (SELECT d_{d}, CASE WHEN o > 0 THEN pow(o / (SELECT sum(tokens) FROM cells), {temperature}) ELSE 0 END / (SELECT sum(pow(o / (SELECT sum(tokens) FROM cells), {temperature})) FROM o_{d} WHERE o > 0) * (SELECT sum(tokens) FROM cells) AS t FROM o_{d})")
    parts.append("w0 AS MATERIALIZED (SELECT *, tokens AS w FROM cells)")
    step = 0
    for _ in range(SQL_ROUNDS):
        for d in DIMENSIONS:
            parts.append(f"w{step + 1} AS MATERIALIZED (SELECT c.* EXCLUDE (w), CASE WHEN sum(w) OVER (PARTITION BY c.d_{d}) > 0 THEN w * t.t / sum(w) OVER (PARTITION BY c.d_{d}) ELSE 0 END AS w FROM w{step} c JOIN t_{d} t USING (d_{d}))")
            step += 1
    parts.append(f"r AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END AS r FROM w{step})")
    parts.append(f"s0 AS MATERIALIZED (SELECT {budget}::DOUBLE AS s)")
    for i in range(SQL_SCALE_ROUNDS):
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT s * {budget} * (SELECT sum(tokens) FROM cells) / (SELECT sum(tokens * least(1, s * r)) FROM r, s{i}) AS s FROM s{i})")
    parts.append(f"p AS (SELECT d_source, d_lang, d_topic, least(1.0, s * r) AS p FROM r, s{SQL_SCALE_ROUNDS})")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, d_topic AS topic, n::BIGINT AS n_tokens, floor(p * 1e6 + 0.5) / 1e6 AS probability, "
        f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < p AS kept FROM marked JOIN p USING (d_source, d_lang, d_topic)"
    )
