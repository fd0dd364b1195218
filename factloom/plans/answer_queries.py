"""Verification and grading of answers: an order is an answer, its lines are results, and what each line claims is right or wrong in
one of several ways that the line's part decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import grading, verification
from factloom.sources.shared import written
from factloom.sources.tables import table

#: What a line's claim is like, by part.
KINDS = ("right", "no such result", "no unit", "short quote", "changed quote", "other value")
CHECKS = ("grounded", "citation_out_of_range", "malformed_claim", "quote_too_short", "quote_not_found", "value_not_in_quote")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, idx, n, kind, price, shown, flag): order lines numbered by what they hold; ``shown``: the price in words' form. Written, as
    every query reads them several times and numbering an order's lines costs more than reading them."""
    order = Window.partitionBy("l_orderkey")
    columns = ("l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_quantity")
    each = table(spark, sf_dir, "lineitem").select("l_orderkey", *columns).withColumns({"idx": F.row_number().over(order.orderBy(*columns)), "n": F.count("*").over(order).cast("int")})
    numbered = each.select(F.col("l_orderkey").alias("answer_id"), "idx", "n", (F.col("l_partkey") % len(KINDS)).cast("int").alias("kind"), F.col("l_extendedprice").alias("price"), F.format_number("l_extendedprice", 2).alias("shown"), F.col("l_returnflag").alias("flag"))
    return written(numbered, "lines")


def _sentence(shown) -> F.Column:
    return F.concat(F.lit("The line of this order was delivered in full and was invoiced at a price of $"), shown, F.lit(" in all, with nothing left open."))


def _said(lines: DataFrame, value) -> DataFrame:
    """(answer_id, answer_text): what an answer says about its lines, one kind left out."""
    sentence = F.struct("idx", F.concat(F.lit("A line costs $"), value, F.lit(" ["), F.col("idx").cast("string"), F.lit("].")).alias("t"))
    said = F.array_sort(F.collect_list(F.when(F.col("kind") != 2, sentence)))
    return lines.groupBy("answer_id").agg(F.array_join(F.transform(said, lambda s: s["t"]), " ").alias("answer_text"))


def _claims(lines: DataFrame) -> DataFrame:
    kind = F.col("kind")
    whole = _sentence(F.col("shown"))
    quote = F.when(kind == 3, "in all").when(kind == 4, F.lit("Quite another sentence about a different matter that mentions none of the above and stands nowhere")).otherwise(whole)
    return lines.select(
        "answer_id", F.col("idx").alias("claim_no"), F.when(kind == 1, F.col("n") + 1).otherwise(F.col("idx")).alias("citation_index"), F.when(kind == 5, F.col("price") * 3).otherwise(F.col("price")).alias("value"),
        F.when(kind != 2, "raw").alias("unit"), quote.alias("quote"),
    )


def _results(lines: DataFrame) -> DataFrame:
    return lines.select("answer_id", "idx", _sentence(F.col("shown")).alias("text"), F.lit(None).cast("string").alias("header"), F.lit("0").alias("chunk_index"))


def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing check of each line's claim."""
    lines = _lines(spark, sf_dir)
    out = verification.claim_verdicts(_claims(lines), _results(lines))
    return out.select("answer_id", "claim_no", F.coalesce("check", F.lit("grounded")).alias("check"))


def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of each answer: its claims, a number that no claim covers in every third, no structure in every eleventh."""
    lines = _lines(spark, sf_dir)
    value = F.when(F.col("kind") == 5, F.format_number(F.col("price") * 3, 2)).otherwise(F.col("shown"))
    extra = F.when(F.col("answer_id") % 3 == 0, " Altogether 987,654,321 were seen.").otherwise("")
    answers = _said(lines, value).select("answer_id", F.lit("What do the lines cost?").alias("question"), F.concat("answer_text", extra).alias("answer_text"), (F.col("answer_id") % 11 != 0).alias("structured"))
    out = verification.gate(answers, _claims(lines), _results(lines))
    shown = F.array_join(F.transform(F.map_entries("warnings"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("answer_id", "withheld", shown.alias("warnings"))


def answer_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's price is expected; lines of one kind are left out of the answer, those of another cite a result that says otherwise."""
    lines = _lines(spark, sf_dir)
    answers = _said(lines, F.col("shown"))
    results = lines.select("answer_id", "idx", F.when(F.col("kind") == 1, _sentence(F.format_number(F.col("price") * 1.5, 2))).otherwise(_sentence(F.col("shown"))).alias("text"))
    expected = lines.select("answer_id", F.col("idx").cast("string").alias("label"), F.col("price").alias("value"), F.lit("raw").alias("unit"), F.lit(0.01).alias("tolerance"))
    return grading.grade_numbers(expected, answers, results).select("answer_id", "passed", F.array_join("missing", ",").alias("missing"))


def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final grades: the total is expected from all companies of the order, or from one too few; the first line's price is a trap for some."""
    lines = _lines(spark, sf_dir)
    leaf = lines.select("answer_id", "idx", F.col("flag").alias("ticker"), F.lit(None).cast("array<int>").alias("operands"), "price", "n")
    orders = leaf.groupBy("answer_id").agg(F.max("n").alias("n"), F.sum(F.floor(F.col("price") * 100 + 0.5)).alias("cents"), F.array_sort(F.collect_set("ticker")).alias("all"), F.max(F.when(F.col("idx") == 1, F.struct("price", "ticker"))).alias("first"))
    # two steps: a subtotal of the results, and the total that rests on it
    subtotal = orders.select("answer_id", (F.col("n") + 1).alias("idx"), F.lit(None).cast("string").alias("ticker"), F.sequence(F.lit(1), F.col("n")).alias("operands"))
    total = orders.select("answer_id", (F.col("n") + 2).alias("idx"), F.lit(None).cast("string").alias("ticker"), F.array(F.col("n") + 1).alias("operands"))
    results = leaf.select("answer_id", "idx", "ticker", "operands").unionByName(subtotal).unionByName(total)
    claims = leaf.select("answer_id", F.col("idx").alias("ord"), F.col("price").alias("value"), F.lit("raw").alias("unit"), F.col("idx").alias("citation_index"))
    claims = claims.unionByName(orders.select("answer_id", (F.col("n") + 2).alias("ord"), (F.col("cents") / 100.0).alias("value"), F.lit("raw").alias("unit"), (F.col("n") + 2).alias("citation_index")))
    attributed = grading.claim_companies(claims, results)
    companies = F.when(F.col("answer_id") % 4 == 0, F.slice("all", 1, F.greatest(F.size("all") - 1, F.lit(0)))).otherwise(F.col("all"))
    expected = orders.select("answer_id", F.lit("total").alias("label"), (F.col("cents") / 100.0).alias("value"), F.lit("raw").alias("unit"), F.lit(0.01).alias("tolerance"), companies.alias("companies"))
    traps = orders.where("answer_id % 5 < 2").select("answer_id", F.lit("first").alias("label"), F.col("first.price").alias("value"), F.lit("raw").alias("unit"), F.lit(0.001).alias("tolerance"), F.when(F.col("answer_id") % 5 == 1, F.array(F.lit("none"))).alias("companies"))
    wrong = grading.misattributed(expected, attributed).select("answer_id", F.lit(True).alias("wrong"))
    trapped = grading.forbidden_hits(traps, attributed).select("answer_id", F.lit(True).alias("trapped"))
    joined = orders.select("answer_id").join(wrong, "answer_id", "left").join(trapped, "answer_id", "left")
    n = F.col("answer_id")
    kind = F.when(n % 13 == 0, "judged").otherwise("numeric")
    grade = grading.final_grade(kind, n % 7 == 0, n % 6 != 0, n % 12 == 0, F.coalesce("wrong", F.lit(False)), F.coalesce("trapped", F.lit(False)))
    return joined.select("answer_id", grade.alias("outcome"))


QUERIES = {f.__name__: f for f in (claim_checks, answer_gate, answer_grades, answer_outcomes)}

_LINES = """l AS (SELECT l_orderkey AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_returnflag, l_quantity) AS idx, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey % 6 AS kind, l_extendedprice AS price, l_returnflag AS flag FROM lineitem)"""
_CHECK = "CASE kind " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CHECKS)) + " END"

ORACLES = {
    "claim_checks": f"WITH {_LINES} SELECT a AS answer_id, idx::INTEGER AS claim_no, {_CHECK} AS \"check\" FROM l",
    "answer_gate": f"""WITH {_LINES}, w AS (SELECT a, {_CHECK} AS c FROM l WHERE kind > 0 UNION ALL SELECT DISTINCT a, 'uncovered_number' FROM l WHERE a % 3 = 0 UNION ALL SELECT DISTINCT a, 'no_structured_answer' FROM l WHERE a % 11 = 0),
c AS (SELECT a, c, count(*) AS n FROM w GROUP BY 1, 2), s AS (SELECT a, string_agg(c || '=' || n, ',' ORDER BY c) AS warnings FROM c GROUP BY 1)
SELECT a AS answer_id, warnings IS NOT NULL AS withheld, warnings FROM (SELECT DISTINCT a FROM l) LEFT JOIN s USING (a)""",
    "answer_grades": f"""WITH {_LINES}, j AS (SELECT e.a, e.idx, count(s.a) AS hits, coalesce(bool_or(s.kind <> 1), true) AS ok FROM l e LEFT JOIN l s ON s.a = e.a AND s.kind <> 2 AND abs(s.price - e.price) <= greatest(abs(e.price) * 0.01::DOUBLE, 0.05::DOUBLE) GROUP BY 1, 2)
SELECT a AS answer_id, bool_and(hits > 0 AND ok) AS passed, coalesce(string_agg(idx::VARCHAR, ',' ORDER BY idx::VARCHAR) FILTER (hits = 0), '') AS missing FROM j GROUP BY 1""",
    "answer_outcomes": f"""WITH {_LINES}, o AS (SELECT a, sum(floor(price * 100 + 0.5)) / 100.0::DOUBLE AS total, list_sort(list_distinct(list(flag))) AS companies, max(price) FILTER (idx = 1) AS first FROM l GROUP BY 1),
claims AS (SELECT a, price AS v, [flag] AS t FROM l UNION ALL SELECT a, total, companies FROM o),
wrong AS (SELECT o.a, bool_or(t = CASE WHEN o.a % 4 = 0 THEN companies[1:len(companies) - 1] ELSE companies END) AS ok FROM o JOIN claims c ON c.a = o.a AND abs(v - total) <= greatest(abs(total) * 0.01::DOUBLE, 0.05::DOUBLE) GROUP BY 1),
trapped AS (SELECT DISTINCT o.a FROM o JOIN claims c ON c.a = o.a AND abs(v - first) <= greatest(abs(first) * 0.001::DOUBLE, 0.05::DOUBLE) WHERE o.a % 5 = 0)
SELECT o.a AS answer_id, CASE WHEN o.a % 13 = 0 THEN 'judged' WHEN o.a % 7 = 0 THEN 'withheld' WHEN NOT (o.a % 6 <> 0 OR o.a % 12 = 0) THEN 'wrong_value' WHEN NOT ok THEN 'misattributed' WHEN t.a IS NOT NULL THEN 'trap' ELSE 'passed' END AS outcome
FROM o JOIN wrong USING (a) LEFT JOIN trapped t USING (a)""",
}
