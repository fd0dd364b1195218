"""Scores of whole calls of a scorer, kept so that the same call is never scored twice.

A call is an exact list of pairs; its key is the digest of that list. Rows lie in segments that a version file names, so a merge
appears at once. A merge adds only keys that are not there, so doing it again changes nothing; if another writer was
first, it looks again. A stored row that does not fit its call (no scores, or another number of them than pairs) disables the
store for the run: every call is then scored anew and nothing is written.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.shared import written
from factloom.sources.sinks import score_key
from factloom.sources.versions import Conflict, VersionedFolder

ATTEMPTS = 8


def store_folder(base: str, identity: list) -> str:
    """The folder for the scores of one model, in one version, and whatever else changes scores."""
    return f"{base.rstrip('/')}/{hashlib.sha256(json.dumps([str(p) for p in identity]).encode()).hexdigest()[:16]}"


@dataclass(frozen=True)
class Served:
    """``scores`` (key, scores) of all calls; how many came from the store, how many were scored, and why it was disabled."""

    scores: DataFrame
    hits: int
    misses: int
    disabled: str | None


class ScoreStore(VersionedFolder):
    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)

    def scores(self) -> DataFrame | None:
        """(key, scores) of all stored calls; null for an empty store. A version file that can't be read is a ValueError."""
        state = self.state()
        if state is None:
            return None
        if not isinstance(state, dict) or not isinstance(state.get("segments"), list):
            raise ValueError(f"{self.path}: the newest version names no segments")
        return self.read(*state["segments"])

    def put(self, scored: DataFrame) -> int:
        """Add scored calls (key, scores) whose keys are not stored yet; of repeated keys one row. Returns how many were added."""
        fresh = written(scored.groupBy("key").agg(F.min("scores").alias("scores")), "scored")
        for _ in range(ATTEMPTS):
            version, state = self.next_version(), self.state()
            stored = self.scores()
            new = fresh if stored is None else fresh.join(stored.select("key"), "key", "left_anti")
            segment = self.stage(new.repartitionByRange("key").sortWithinPartitions("key"), "segments")  # keys lie apart, so files can be skipped
            added = self.read(segment).count()
            if not added:
                return 0
            try:
                self.commit(version, {"segments": [*(state or {"segments": []})["segments"], segment]})
                return added
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {ATTEMPTS} other writers were faster")


def cached_scores(calls: DataFrame, scorer: Callable[[DataFrame], DataFrame], store: ScoreStore | None) -> Served:
    """Scores of calls (pairs: an array); ``scorer`` turns calls (key, pairs) into (key, scores), one score for each pair."""
    keyed = written(calls.select(score_key("pairs").alias("key"), "pairs").groupBy("key").agg(F.first("pairs").alias("pairs")), "calls")
    disabled, stored = None if store else "at open", None
    if store:
        try:
            stored = store.scores()
        except ValueError as error:
            disabled = f"at open: {error}"
    if stored is not None:
        found = written(keyed.join(stored, "key"), "found")
        corrupt = found.where(F.col("scores").isNull() | (F.size("scores") != F.size("pairs")) | F.exists("scores", lambda s: s.isNull())).count()
        if corrupt:
            disabled = f"mid-run: {corrupt} stored rows do not fit their calls"
    if disabled:
        return Served(scorer(keyed), 0, keyed.count(), disabled)
    hits = found.select("key", "scores") if stored is not None else keyed.select("key", F.lit(None).cast("array<double>").alias("scores")).limit(0)
    missing = keyed.join(hits.select("key"), "key", "left_anti")
    scored = written(scorer(missing).select("key", F.col("scores").cast("array<double>").alias("scores")), "scored")
    misses = scored.count()
    if misses:
        store.put(scored)
    return Served(hits.unionByName(scored), hits.count(), misses, None)
