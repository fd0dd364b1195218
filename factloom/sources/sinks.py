"""Writes: chunk and vector tables by partition, reports, score tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, partition: str = "ticker") -> None:
    """Replace the partitions that ``chunks`` holds, keep the others. A large partition is written by several tasks: rows are dealt
    by range of partition and id, so that each task holds few partitions."""
    keys = [partition, *[c for c in ("accession", "doc_id", "chunk_index") if c in chunks.columns]]
    chunks.repartitionByRange(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def apply_manifest(stored: DataFrame, fresh: DataFrame, actions: DataFrame) -> DataFrame:
    """Rows of an index after an update: rows of unchanged files stay, replaced and deleted ones go, fresh ones come."""
    gone = actions.where("action in ('replace', 'delete')").select("relpath")
    come = actions.where("action in ('add', 'replace')").select("relpath")
    return stored.join(gone, "relpath", "left_anti").unionByName(fresh.join(come, "relpath", "left_semi"))


def write_report(rows: DataFrame, folder: str, stamp: str) -> str:
    path = f"{folder}/{stamp}"
    rows.write.json(path)
    return path


def append_trace(records: DataFrame, folder: str) -> bool:
    """Append records to a trace log; a log that can't be written is warned of and never stops the work that it describes.
    For records that must enter a log exactly once see ``streaming.log``."""
    try:
        records.write.mode("append").json(folder)
    except Exception as error:  # noqa: BLE001
        warnings.warn(f"trace log {folder} was not written: {str(error).splitlines()[0]}", stacklevel=2)
        return False
    return True


def score_key(pairs: str = "pairs"):
    """Key of a whole scoring call: the digest of its exact list of pairs."""
    return F.sha2(F.to_json(F.struct(pairs)), 256)


def cache_misses(calls: DataFrame, cached: DataFrame) -> DataFrame:
    """Calls (key, pairs) without a usable cached row (key, scores): the number of scores must be that of the pairs."""
    good = cached.select("key", F.size("scores").alias("_n"))
    return calls.join(good, (calls["key"] == good["key"]) & (F.size("pairs") == F.col("_n")), "left_anti")
