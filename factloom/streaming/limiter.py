"""Fixed-window rate limiting per key: a window starts with a key's first allowed request and denied requests don't count."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST = 60
WINDOW_SECONDS = 60


def decide(start: float | None, used: int, now: float, most: int, seconds: float) -> tuple[float, int, bool]:
    """(window start, requests used, allowed) after one request; ``most`` of 0 or less allows all."""
    if most <= 0:
        return now, 0, True
    if start is None or now - start >= seconds:
        return now, 1, True
    return (start, used + 1, True) if used < most else (start, used, False)


def limit_batch(requests: DataFrame, most: int = MOST, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """requests (key, ts, ord) with ``allowed``.

    A key's requests stand in time order in one partition and are folded as they stream by: the state is one window and one
    count, so a key with a large share of all rows costs time in one task, but no memory.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, used = object(), None, 0
        for batch in batches:
            allowed = []
            for key, now in zip(batch["key"], batch["us"], strict=True):
                if key != current:
                    current, start, used = key, None, 0
                start, used, ok = decide(start, used, now, most, seconds * 1_000_000)
                allowed.append(ok)
            yield pd.DataFrame({"key": batch["key"], "ord": batch["ord"], "allowed": allowed})

    kind = dict(requests.dtypes)["key"]
    ordered = requests.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ord").cast("long").alias("ord")).repartition("key").sortWithinPartitions("key", "us", "ord")
    return ordered.mapInPandas(fold, f"key {kind}, ord long, allowed boolean")


def limit_stream(requests: DataFrame, most: int = MOST, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Streaming form over (key, ts, ord): a key's state is its window start and count, kept across micro-batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        for batch in batches:
            rows = []
            for ts, ord_ in batch.sort_values(["ts", "ord"])[["ts", "ord"]].itertuples(index=False):
                start, used, allowed = decide(start, used, ts.timestamp(), most, seconds)
                rows.append((key[0], ord_, allowed))
            yield pd.DataFrame(rows, columns=["key", "ord", "allowed"])
        if start is not None:
            state.update((float(start), int(used)))

    return requests.groupBy("key").applyInPandasWithState(run, "key long, ord long, allowed boolean", "start double, used int", "append", GroupStateTimeout.NoTimeout)
