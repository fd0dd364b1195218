"""Fiscal calendar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns and names: canonical dates, months, fiscal years and quarters in questions.
CANONICAL_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
NAMED_YEAR = "(?i)\\b(?:fiscal(?:\\s+year)?|fy)\\s*'?(\\d{4}|\\d{2})\\b"
NAMED_QUARTER = "(?i)\\b(q[1-4]|(?:first|second|third|fourth)\\s+(?:fiscal\\s+)?quarter)\\b"


def is_canonical_date(text: Column) -> Column:
    """YYYY-MM-DD that is a real calendar date."""
    return F.coalesce(text.rlike(CANONICAL_DATE) & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def fiscal_year(date: Column, end_month: Column) -> Column:
    return F.year(date) + (F.month(date) > end_month).cast("int")


def fiscal_quarter(date: Column, end_month: Column) -> Column:
    return (F.floor(F.pmod(F.month(date) - end_month - 1, F.lit(12)) / 3) + 1).cast("int")


def period_label(date: Column, end_month: Column, form: Column) -> Column:
    """'fiscal year 2024' for an annual report, 'Q2 of fiscal year 2024' otherwise, with the end date."""
    year = fiscal_year(date, end_month).cast("string")
    label = F.when(form == "10-K", F.concat(F.lit("fiscal year "), year)).otherwise(F.concat(F.lit("Q"), fiscal_quarter(date, end_month).cast("string"), F.lit(" of fiscal year "), year))
    return F.concat(label, F.lit(", ended "), F.date_format(date, "MMMM d, yyyy"))


def duration_days(start: Column, end: Column) -> Column:
    """Days of a period; null for an instant, which has no start."""
    return F.datediff(end, start)


def resolved_fiscal_year(fiscal_period: Column, end: Column, fy: Column) -> Column:
    """An annual value's fiscal year is that of its end date, whatever its filing says."""
    return F.when(fiscal_period == "FY", F.year(end)).otherwise(fy)


def named_dates(query: Column) -> Column:
    """Dates that a question names as 'Month D, YYYY'; null entries are not real dates."""
    pattern = "(?i)\\b(?:" + "|".join(MONTHS) + ")\\s+\\d{1,2},?\\s+\\d{4}"
    found = F.regexp_extract_all(query, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda t: F.try_to_timestamp(F.initcap(F.regexp_replace(F.regexp_replace(t, ",", " "), "\\s+", " ")), F.lit("MMMM d yyyy")).cast("date"))


def named_fiscal_year(query: Column) -> Column:
    """The first fiscal year that a question names; two digits mean 20xx."""
    text = F.nullif(F.regexp_extract(query, NAMED_YEAR, 1), F.lit(""))
    year = text.cast("int")
    return F.when(year < 100, year + 2000).otherwise(year)


def named_quarter(query: Column) -> Column:
    """The first quarter that a question names, as a digit or an ordinal."""
    found = F.lower(F.regexp_extract(query, NAMED_QUARTER, 1))
    quarter = F.when(found.startswith("q"), F.substring(found, 2, 1).cast("int"))
    for i, word in enumerate(("first", "second", "third", "fourth"), 1):
        quarter = quarter.when(found.startswith(word), i)
    return quarter
