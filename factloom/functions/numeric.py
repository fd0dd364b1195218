"""Numeric rules as Column expressions: unit normalisation, tolerance matching, ratios, growth and arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of the unit words, tolerance defaults.
UNIT_MULTIPLIERS = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
CLAIM_UNITS = ("raw", *UNIT_MULTIPLIERS, "percent")
RELATIVE_TOLERANCE = 0.01
LEAST_TOLERANCE = 0.05


def category(unit: Column) -> Column:
    """'percent' is a scale of its own; all other units compare on one scale."""
    return F.when(unit == "percent", "percent").otherwise("scale")


def normalised(value: Column, unit: Column) -> Column:
    factor = F.lit(1.0)
    for name, multiplier in UNIT_MULTIPLIERS.items():
        factor = F.when(unit == name, multiplier).otherwise(factor)
    return F.when(unit == "percent", value).otherwise(value * factor)


def tolerance(expected: Column, relative: float = RELATIVE_TOLERANCE) -> Column:
    """Absolute band around a normalised value: a share of it, never below ``LEAST_TOLERANCE``."""
    return F.greatest(F.abs(expected) * relative, F.lit(LEAST_TOLERANCE))


def num_match(found_category: Column, found: Column, expected_category: Column, expected: Column, relative: float = RELATIVE_TOLERANCE) -> Column:
    """Whether ``found`` is within the band of ``expected``; the expected side scales the band."""
    return (found_category == expected_category) & (F.abs(found - expected) <= tolerance(expected, relative))


def tolerance_bucket(value: Column) -> Column:
    """Number of the bucket of a normalised value: two values within the band of one of them lie in the same bucket or in
    neighbouring ones. The scale is linear near zero and logarithmic beyond, like the band itself."""
    step = RELATIVE_TOLERANCE * 1.1
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * RELATIVE_TOLERANCE / LEAST_TOLERANCE) / step)


def band_buckets(value: Column, band: Column) -> Column:
    """The buckets that numbers within ``band`` of a value may lie in: an equi-join on them misses none, as buckets grow with values."""
    return F.sequence(tolerance_bucket(value - band), tolerance_bucket(value + band))


def rounded(value: Column, decimals: int) -> Column:
    """Rounding that DuckDB can repeat to the last bit: floor(x * 10^k + 0.5) / 10^k."""
    scale = float(10**decimals)
    return F.floor(value * scale + 0.5) / scale


def ratio(numerator: Column, denominator: Column, as_percent: Column | bool) -> Column:
    """A percentage to one decimal or a raw ratio to two; null if the denominator is zero."""
    flag = F.lit(as_percent) if isinstance(as_percent, bool) else as_percent
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.when(flag, rounded(quotient * 100, 1)).otherwise(rounded(quotient, 2))


def growth(current: Column, prior: Column) -> Column:
    """Change against the prior value in percent to one decimal; null if the prior value is missing or zero."""
    return rounded(F.try_divide((current - prior).cast("double"), F.abs(prior).cast("double")) * 100, 1)


def calculate(operation: Column, a: Column, unit_a: Column, b: Column, unit_b: Column) -> Column:
    """Struct(value, error) of a checked calculation on two figures.

    Operands must be of one category for add, subtract and the percentages; a zero divisor has no result.
    """
    x, y = normalised(a, unit_a), normalised(b, unit_b)
    same = category(unit_a) == category(unit_b)
    divides = operation.isin("divide", "percent_of", "percent_change")
    value = (
        F.when(operation == "add", x + y).when(operation == "subtract", x - y).when(operation == "multiply", x * y)
        .when(operation == "divide", rounded(F.try_divide(x, y), 2))
        .when(operation == "percent_of", rounded(F.try_divide(x, y) * 100, 1))
        .when(operation == "percent_change", rounded(F.try_divide(x - y, F.abs(y)) * 100, 1))
    )
    known = operation.isin("add", "subtract", "multiply", "divide", "percent_of", "percent_change")
    divisor = y
    error = F.when(~known, "unknown_operation").when(operation.isin("add", "subtract", "divide", "percent_of", "percent_change") & ~same, "category_mismatch").when(divides & (divisor == 0), "zero_divisor")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def wilson(passed: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval."""
    p = F.try_divide(passed.cast("double"), total.cast("double"))
    z2 = z * z
    middle = (p + z2 / (2 * total)) / (1 + z2 / total)
    half = z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / (1 + z2 / total)
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))


def printed_figure_match(value: Column, printed: Column, decimals: Column) -> Column:
    """Within half a unit of the last printed digit, with a relative slack of 1e-9."""
    return F.abs(value - printed) <= 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-9 * F.abs(printed)


def fixed_point(value: Column) -> Column:
    """Plain decimal text with at most six decimals and no trailing zeros."""
    text = value.cast("decimal(38,6)").cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")).otherwise(text)
