"""Tailing an append-only trace log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def tail(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """Stream of records (raw, run_id, kind, timestamp) of JSON lines; lines that are no object are left out. ``files``: how many
    new files a micro-batch takes at most."""
    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    lines = reader.text(folder)
    raw = lines.select(F.try_parse_json("value").alias("raw")).where(F.schema_of_variant("raw").startswith("OBJECT"))
    get = lambda name: F.try_variant_get("raw", f"$.{name}", "string")
    return raw.select("raw", get("run_id").alias("run_id"), F.coalesce(get("category"), get("name")).alias("kind"), get("timestamp").alias("timestamp"))


def run_counts(records: DataFrame) -> DataFrame:
    """Records and distinct kinds of each run so far; a log has few kinds."""
    return records.where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("n"), F.size(F.collect_set("kind")).alias("kinds"), F.min("timestamp").alias("first"))


def write_all(records: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there and stop; result in the memory table ``name`` (for tools and tests)."""
    return records.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
