"""Nested company facts as flat rows, and discovery of tags in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECENT_DAYS = 400
ENTRY = "struct<start:string,end:string,val:double,accn:string,fy:string,fp:string,form:string,filed:string,frame:string>"
SCHEMA = f"map<string,map<string,struct<label:string,units:map<string,array<{ENTRY}>>>>>"


def flatten(raw: DataFrame) -> DataFrame:
    """Rows (ticker, taxonomy, tag, unit, ord, entry fields, has_start) of JSON texts (ticker, facts)."""
    parsed = raw.select("ticker", F.from_json("facts", SCHEMA).alias("f"), "facts")
    tags = parsed.select("ticker", F.explode("f").alias("taxonomy", "tags")).select("ticker", "taxonomy", F.explode("tags").alias("tag", "t"))
    units = tags.select("ticker", "taxonomy", "tag", "t.label", F.explode("t.units").alias("unit", "entries"))
    rows = units.select("ticker", "taxonomy", "tag", "label", "unit", F.posexplode("entries").alias("ord", "e")).select("ticker", "taxonomy", "tag", "label", "unit", "ord", "e.*")
    return rows.withColumn("has_start", F.col("start").isNotNull())


def list_tags(flat: DataFrame, today: str, keyword: str | None = None, recent_only: bool = True, taxonomy: str = "us-gaap") -> DataFrame:
    """(ticker, tag, n, last) of a taxonomy's tags that hold a keyword and have an entry of the last ``RECENT_DAYS`` days."""
    out = flat.where(F.col("taxonomy") == taxonomy)
    out = out.where(F.col("tag").ilike(f"%{keyword}%")) if keyword else out
    out = out.groupBy("ticker", "tag").agg(F.count("*").alias("n"), F.max("end").alias("last"))
    return out.where(F.col("last") >= F.date_sub(F.lit(today).cast("date"), RECENT_DAYS).cast("string")) if recent_only else out
