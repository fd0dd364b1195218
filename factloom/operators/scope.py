"""Period scope of questions: which filings a named date or fiscal period means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import fiscal

DATE_TOLERANCE_DAYS = 7


def filing_list(chunks: DataFrame) -> DataFrame:
    """One row per filing (ticker, form, report_date), with the position at which it was first seen."""
    return chunks.groupBy("ticker", "form", "report_date").agg(F.min("pos").alias("first_seen"))


def near_dates(named: DataFrame, filings: DataFrame, days: int = DATE_TOLERANCE_DAYS) -> DataFrame:
    """Pairs of a named date (query_id, ticker or null, target) and a filing's report date at most ``days`` apart.

    A range join made an equi-join: both sides carry the number of their bucket of ``days`` days, and a named date
    looks into its own bucket and the two beside it.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    asked = named.withColumn("_bucket", F.explode(F.array(bucket(F.col("target")) - 1, bucket(F.col("target")), bucket(F.col("target")) + 1)))
    have = filings.withColumn("_bucket", bucket(F.col("report_date"))).withColumnRenamed("ticker", "filing_ticker")
    near = asked.join(have, "_bucket").where(F.abs(F.datediff("report_date", "target")) <= days)
    return near.where(F.col("ticker").isNull() | (F.col("ticker") == F.col("filing_ticker"))).drop("_bucket")


def fiscal_matches(asked: DataFrame, filings: DataFrame, calendars: DataFrame) -> DataFrame:
    """Filings of a fiscal year (query_id, ticker or null, fy, quarter): its annual report, or the named quarter's report.

    calendars (ticker, end_month); filings of companies without one can't be told and are left out.
    """
    labelled = filings.join(calendars, "ticker").select(
        F.col("ticker").alias("filing_ticker"), "form", "report_date",
        fiscal.fiscal_year(F.col("report_date"), F.col("end_month")).alias("fy"), fiscal.fiscal_quarter(F.col("report_date"), F.col("end_month")).alias("fq"),
    )
    fits = F.when(F.col("quarter").isNull(), F.col("form") == "10-K").otherwise(F.col("fq") == F.col("quarter"))
    return asked.join(labelled, "fy").where(fits & (F.col("ticker").isNull() | (F.col("ticker") == F.col("filing_ticker"))))


def query_scopes(queries: DataFrame, filings: DataFrame, calendars: DataFrame) -> DataFrame:
    """(query_id, report_dates, reason, n_invalid) of queries (query_id, ticker, query): explicit dates first; only if none
    matches a filing, the first fiscal year and quarter that the query names."""
    parsed = queries.select("query_id", "ticker", fiscal.named_dates(F.col("query")).alias("dates"), fiscal.named_fiscal_year(F.col("query")).alias("fy"), fiscal.named_quarter(F.col("query")).alias("quarter"))
    targets = parsed.select("query_id", "ticker", F.explode("dates").alias("target")).where("target is not null")
    explicit = near_dates(targets, filings).groupBy("query_id").agg(F.array_sort(F.collect_set("report_date")).alias("explicit"))
    by_year = fiscal_matches(parsed.where("fy is not null").select("query_id", "ticker", "fy", "quarter"), filings, calendars)
    by_year = by_year.groupBy("query_id").agg(F.array_sort(F.collect_set("report_date")).alias("by_year"))
    joined = parsed.join(explicit, "query_id", "left").join(by_year, "query_id", "left")
    dates = F.coalesce("explicit", "by_year", F.array().cast("array<date>"))
    valid = F.size(F.filter("dates", lambda d: d.isNotNull()))
    reason = F.when(F.size(dates) > 0, "dates").when((valid > 0) | F.col("fy").isNotNull(), "no_match").otherwise("no_date")
    return joined.select("query_id", dates.alias("report_dates"), reason.alias("reason"), (F.size("dates") - valid).alias("n_invalid"))
