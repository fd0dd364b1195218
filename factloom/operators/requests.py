"""Tool requests as rows: argument checks, routing to the kind of answer, and the log of what could not be answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import formulas

#: Types of a checked argument and the variant schemas that pass for them; a boolean is no number.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def coerce_year(value: Column) -> Column:
    """A year as int from four digits or a whole number; null otherwise."""
    return F.when(value.rlike(r"^[1-9][0-9]{3}(\.0+)?$"), F.substring(value, 1, 4).cast("int"))


def argument_defect(args: Column, schema: dict[str, dict], soft: tuple[str, ...] = ()) -> Column:
    """First defect of JSON arguments against {name: {type, required, enum}}, or null.

    In order: an undeclared name (null or not), a missing required one, a wrong type, a value outside an enum; each in the order
    of the schema. A null optional argument counts as absent; enums of ``soft`` names are not enforced.
    """
    raw = F.try_parse_json(args)
    names = F.coalesce(F.json_object_keys(args), F.array().cast("array<string>"))
    strange = F.array_except(names, F.array(*[F.lit(n) for n in schema]))
    defect = F.when(raw.isNull() | ~F.schema_of_variant(raw).startswith("OBJECT"), "not_an_object").when(F.size(strange) > 0, F.concat(F.lit("unexpected:"), strange[0]))
    got = {n: F.try_variant_get(raw, f"$.{n}", "variant") for n in schema}
    present = {n: v.isNotNull() & (F.schema_of_variant(v) != "VOID") for n, v in got.items()}
    for n, rule in schema.items():
        if rule.get("required"):
            defect = defect.when(~F.coalesce(present[n], F.lit(False)), f"missing:{n}")
    for n, rule in schema.items():
        kinds = TYPES[rule["type"]]
        fits = F.schema_of_variant(got[n]).startswith(kinds[0])
        for k in kinds[1:]:
            fits = fits | F.schema_of_variant(got[n]).startswith(k)
        defect = defect.when(F.coalesce(present[n], F.lit(False)) & ~fits, f"type:{n}")
    for n, rule in schema.items():
        if rule.get("enum") and n not in soft:
            defect = defect.when(F.coalesce(present[n], F.lit(False)) & ~F.try_variant_get(raw, f"$.{n}", "string").isin(*rule["enum"]), f"enum:{n}")
    return defect


def route(requests: DataFrame, metrics: DataFrame, ratios: DataFrame) -> DataFrame:
    """requests (request_id, entity, metric, fy, fp, first_year, last_year, growth) with ``route``: average, growth, ratio, metric or
    unknown_metric. Averages come first, then growth, then ratios; metrics and ratios are the small registries."""
    known = metrics.select("metric", F.lit(True).alias("_metric"))
    named = ratios.select(F.col("ratio").alias("metric"), F.lit(True).alias("_ratio"))
    joined = requests.join(known, "metric", "left").join(named, "metric", "left")
    some = F.col("_metric").isNotNull() | F.col("_ratio").isNotNull()
    kind = F.when(~some, "unknown_metric").when(F.col("first_year").isNotNull() & F.col("last_year").isNotNull(), "average").when(F.coalesce("growth", F.lit(False)) & F.col("_metric").isNotNull(), "growth").when(F.col("_ratio").isNotNull(), "ratio").otherwise("metric")
    return joined.withColumn("route", kind).drop("_metric", "_ratio")


def answer(requests: DataFrame, resolved: DataFrame, ratios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers (request_id, route, value), unmet (request_id, metric, reason)) from resolved yearly facts.

    Four sub-plans over the routed requests, one for each kind; ratios count as facts for averages.
    """
    routed = route(requests, resolved.select("metric").distinct(), ratios)
    ratio_values = formulas.ratios(resolved, ratios)
    every = resolved.select("entity", "metric", "fy", "fp", "value").unionByName(ratio_values.select("entity", F.col("ratio").alias("metric"), "fy", "fp", "value"))
    measured = resolved.select("entity", "metric", "fy", "fp", "value", F.lit(None).cast("string").alias("unit")).unionByName(ratio_values.select("entity", F.col("ratio").alias("metric"), "fy", "fp", F.col("raw").alias("value"), "unit"))
    mean = formulas.multi_year_average(measured.where("fp = 'FY'"), routed.where("route = 'average'").select("request_id", "entity", "metric", "first_year", "last_year"))
    grown = formulas.yoy_growth(resolved).join(routed.where("route = 'growth'").select("request_id", "entity", "metric", "fy", "fp"), ["entity", "metric", "fy", "fp"])
    plain = every.join(routed.where("route in ('ratio', 'metric')").select("request_id", "route", "entity", "metric", "fy", "fp"), ["entity", "metric", "fy", "fp"])
    answers = mean.select("request_id", F.lit("average").alias("route"), F.col("mean").alias("value")).unionByName(grown.select("request_id", F.lit("growth").alias("route"), F.col("growth").alias("value"))).unionByName(plain.select("request_id", "route", "value"))
    missing = routed.join(answers.select("request_id"), "request_id", "left_anti")
    return answers, missing.select("request_id", "metric", F.when(F.col("route") == "unknown_metric", "unknown_metric").otherwise("no_data_for_entity").alias("reason"))
