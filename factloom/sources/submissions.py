"""Filing lists that arrive as parallel arrays, and the choice of filings to ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.fiscal import fiscal_year, is_canonical_date

FORMS = ("10-K", "10-Q")
MIN_FISCAL_YEAR = 2024
COLUMNS = ("form", "accessionNumber", "filingDate", "primaryDocument", "reportDate")
PAGE_SCHEMA = ", ".join(f"{c} array<string>" for c in COLUMNS)


def submission_rows(pages: DataFrame) -> DataFrame:
    """Rows of pages (ticker, page, and the parallel arrays); arrays of unequal length are an error, not padded."""
    sizes = [F.size(c) for c in COLUMNS]
    equal = sizes[0] == sizes[1]
    for s in sizes[2:]:
        equal = equal & (sizes[0] == s)
    checked = F.when(equal, F.arrays_zip(*COLUMNS)).otherwise(F.raise_error("columns of a submissions page differ in length").cast("array<struct<" + ",".join(f"{c}:string" for c in COLUMNS) + ">>"))
    return pages.select("ticker", "page", F.posexplode(checked).alias("pos", "r")).select("ticker", "page", "pos", "r.*")


def reject_reason() -> Column:
    """First failing check of a filing row, or null."""
    text = F.lit(True)
    for c in COLUMNS:
        text = text & F.col(c).isNotNull()
    report_ok = is_canonical_date(F.col("reportDate"))
    return (
        F.when(~text, "non_string_field").when(~F.col("accessionNumber").rlike(r"^\d{10}-\d{2}-\d{6}$"), "bad_accession").when(~F.col("primaryDocument").rlike(r"^[\w.-]+$"), "bad_primary_document")
        .when(~is_canonical_date(F.col("filingDate")), "bad_filing_date").when(~report_ok, "bad_report_date")
    )


def select_filings(rows: DataFrame, companies: DataFrame, min_year: int = MIN_FISCAL_YEAR) -> tuple[DataFrame, DataFrame]:
    """(filings of the wanted forms from ``min_year`` on, counts of rejected rows by reason)."""
    wanted = rows.where(F.col("form").isin(*FORMS)).withColumn("reason", reject_reason())
    good = wanted.where("reason is null").join(companies.select("ticker", "fiscal_year_end_month"), "ticker")
    year = fiscal_year(F.col("reportDate").cast("date"), F.col("fiscal_year_end_month"))
    return good.withColumn("fiscal_year", year).where(F.col("fiscal_year") >= min_year).drop("reason"), wanted.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def pages_needed(rows: DataFrame, companies: DataFrame, min_year: int = MIN_FISCAL_YEAR) -> DataFrame:
    """(ticker, page, need_older): whether the oldest valid filing of a page is still recent enough to look at an older page."""
    dated = rows.where(is_canonical_date(F.col("filingDate"))).join(companies.select("ticker", "fiscal_year_end_month"), "ticker")
    oldest = dated.groupBy("ticker", "page").agg(F.min(fiscal_year(F.col("filingDate").cast("date"), F.col("fiscal_year_end_month"))).alias("oldest"))
    return oldest.select("ticker", "page", (F.col("oldest") >= min_year).alias("need_older"))


def not_ingested(filings: DataFrame, ingested: DataFrame) -> DataFrame:
    """Filings that the manifest of finished ones does not hold."""
    return filings.join(ingested.select("ticker", "accessionNumber"), ["ticker", "accessionNumber"], "left_anti")


def load_companies(spark: SparkSession, path: str) -> DataFrame:
    """Company registry from a JSON object by ticker. The schema is closed: a missing, ill-formed or unknown field is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    entries = raw.select(F.explode("m").alias("ticker", "entry"))
    rows = entries.select("ticker", F.json_object_keys("entry").alias("keys"), F.from_json("entry", "name string, cik string, fiscal_year_end_month int").alias("c")).select("ticker", "keys", "c.*")
    strange = F.array_except("keys", F.array(*map(F.lit, ("name", "cik", "fiscal_year_end_month"))))
    ok = F.col("name").isNotNull() & F.col("cik").rlike(r"^\d{1,10}$") & F.col("fiscal_year_end_month").between(1, 12)
    problem = F.when(F.size(strange) > 0, F.concat(F.lit("unknown field "), strange[0], F.lit(" of company "), "ticker")).when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("bad company "), "ticker"))
    checked = F.when(problem.isNull(), F.col("fiscal_year_end_month")).otherwise(F.raise_error(problem).cast("int"))
    return rows.withColumn("fiscal_year_end_month", checked).drop("keys")
