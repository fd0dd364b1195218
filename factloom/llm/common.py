"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast after it has been counted; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: A key is hot if it holds more than one in so many rows.
HOT_KEYS = 1_000
#: Rows of an Arrow batch of texts: a few megabytes at some kilobytes a text.
TEXT_ROWS = 1_000
#: Bytes of text whose words are hashed at a time.
PIECE = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the session names; set one only where none is named (a local test)."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: lineage is cut as by ``checkpoint``, and it takes less disk."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Send long texts to Python in Arrow batches of ``TEXT_ROWS`` rows, unless the session's setting is not Spark's default.

    The setting is one of the session and read when a plan runs, so it stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(TEXT_ROWS))


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if its counted ``rows`` are within ``limit``; else for a shuffled join, whatever its size is estimated at."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def keyed_join(rows: DataFrame, unique: DataFrame, key: str, weight: str, size: int | None = None, limit: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """Join of ``rows``, in which some values of ``key`` may be hot, with a table of unique keys.

    ``weight`` names the column of the table that counts the rows of each key; it is not returned. The table is broadcast
    if its counted ``size`` (its rows unless given) is within ``limit``. Otherwise only the keys that hold more than one in
    ``HOT_KEYS`` of all rows are, of which there are at most ``HOT_KEYS``; the rows of the others meet in a shuffle.
    """
    slim = unique.drop(weight)
    if (unique.count() if size is None else size) <= limit:
        return rows.join(F.broadcast(slim), key, how)
    total = unique.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_KEYS > total
    few = F.broadcast(unique.where(hot).drop(weight))
    apart = rows.join(F.broadcast(unique.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(apart.join(unique.where(~hot).drop(weight).hint("merge"), key, how))


def text_slices(texts: list[str | None], chars: int = 500_000) -> Iterator[slice]:
    """Runs of texts of about so many characters, or of one longer text."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held > chars or i == len(texts) - 1:
            yield slice(start, i + 1)
            start, held = i + 1, 0


def apart(spans: list[tuple], base: list[tuple], start: int = 0, end: int = -1) -> list[tuple]:
    """Those of ``spans`` that overlap none of ``base``, in one pass over both in order; places of start and end in a span are given."""
    out, ordered, at, reach = [], sorted(base, key=lambda b: b[start]), 0, -1
    for span in sorted(spans, key=lambda s: s[end]):
        while at < len(ordered) and ordered[at][start] < span[end]:
            reach = max(reach, ordered[at][end])
            at += 1
        if reach <= span[start]:
            out.append(span)
    return out


@cache
def _byte_values(lower: bool, seed: int) -> np.ndarray:
    """A fixed random number for each byte; with ``lower`` the same for A-Z and a-z."""
    values = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 64, 256, dtype=np.uint64)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def word_hashes(units: np.ndarray, marks: bytes = b"", lower: bool = False, seed: int = 2024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash, holds a byte of ``marks``) of each word in UTF-8 bytes; words end at ASCII white space.

    The hash of bytes s to e is the sum of value[i] * odd ** (i - s), taken from running sums and the inverse of odd. Long
    input is cut at white space, so the running sums stay small.
    """
    parts, at = [], 0
    while at < len(units) or not parts:
        end = len(units)
        if at + PIECE < end:
            blank = np.flatnonzero(units[at + PIECE : at + 2 * PIECE] == 32)
            end = at + PIECE + int(blank[0]) if len(blank) else end
        starts, hashes, marked = _word_hashes(units[at:end], marks, lower, seed)
        parts.append((starts + at, hashes, marked))
        at = end
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _word_hashes(units: np.ndarray, marks: bytes, lower: bool, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = (units != 32) & ((units < 9) | (units > 13))
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)) if len(units) else np.empty(0, np.int64)
    starts, ends = edges[::2], edges[1::2]
    odd = 0xC2B2AE3D27D4EB4F
    with np.errstate(over="ignore"):
        up = np.full(len(units), np.uint64(odd))
        up[:1] = 1
        np.cumprod(up, out=up)
        sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(_byte_values(lower, seed)[units] * up, out=sums[1:])
        down = np.full(len(units), np.uint64(pow(odd, -1, 1 << 64)))
        down[:1] = 1
        np.cumprod(down, out=down)
        hashes = (sums[ends] - sums[starts]) * down[starts]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
    if not marks:
        return starts, hashes, np.zeros(len(starts), bool)
    table = np.zeros(256, np.int64)
    table[list(marks)] = 1
    found = np.concatenate([[0], np.cumsum(table[units])])
    return starts, hashes, found[ends] > found[starts]
