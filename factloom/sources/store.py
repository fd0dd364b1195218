"""A store of indexed rows on Parquet, with updates by file that become visible all at once.

A store is a folder. Rows lie in segments, one for each update; a list of files says which files they were made from; a list of
deletions says up to which version the rows of an accession are gone. All are written under new names first. Then one
small version file names them: it appears by a rename that fails if another writer was there before, so a reader sees an
update whole or not at all, and a writer that dies leaves nothing that anyone reads. The newest version file is the store's
sidecar: the corpus identity, the recipe, the number of rows.

An update writes the rows of new and changed files only. Rows of a replaced or removed file go by its accession, so a file that
comes back with fewer rows leaves no orphans. ``compact`` writes the live rows as one segment.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.corpus import manifest_diff
from factloom.sources.shared import small_side, written
from factloom.sources.versions import Conflict, VersionedFolder

__all__ = ["ChunkStore", "Conflict", "Update"]

VERSION = "_version"


@dataclass(frozen=True)
class Update:
    """What an update decided and did; ``reason`` of a full rebuild, or null."""

    version: int
    reason: str | None
    added: int
    deleted: int


#: Tables derived from rows: given the tables so far (none on a full rebuild), the rows that come and those that go.
Derive = Callable[[dict[str, DataFrame], DataFrame, DataFrame | None], dict[str, DataFrame]]


class ChunkStore(VersionedFolder):
    """``path``: a folder that all executors reach. Rows need relpath and accession."""

    # the sidecar

    def head(self) -> dict | None:
        """The newest sidecar; null if there is none or it was cleared. One that can't be read or has no identity is an error."""
        sidecar = self.state()
        if sidecar is None:
            return None
        if isinstance(sidecar, dict) and sidecar.get("cleared"):
            return None
        if not isinstance(sidecar, dict) or not isinstance(sidecar.get("sha"), str):
            raise ValueError(f"{self.path}: the newest version holds no corpus sha")
        return sidecar

    def head_or_none(self) -> dict | None:
        """As ``head``, and null for a sidecar that can't be trusted: the next update then rebuilds."""
        try:
            return self.head()
        except ValueError:
            return None

    def clear(self) -> None:
        """Forget the identity, so that the next update is a full rebuild whatever happens until then."""
        version = self.next_version()
        self.commit(version, {"cleared": True, "version": version})

    # rows

    def rows(self, sidecar: dict | None = None) -> DataFrame:
        """The live rows of a version, the newest unless given, with the version that they came with."""
        sidecar = sidecar or self.head()
        rows = self.read(*sidecar["segments"])
        if not sidecar["gone"]:
            return rows
        gone = small_side(self.read(sidecar["gone"]).select(F.col("accession").alias("_a"), "upto"), sidecar["gone_rows"])
        return rows.join(gone, (rows["accession"] == gone["_a"]) & (rows[VERSION] <= gone["upto"]), "left_anti")

    def files(self, sidecar: dict | None = None) -> DataFrame:
        return self.read((sidecar or self.head())["files"])

    def tables(self, sidecar: dict | None = None) -> dict[str, DataFrame]:
        return {k: self.read(v) for k, v in (sidecar or self.head())["tables"].items()}

    # updates

    def plan(self, files: DataFrame, recipe: dict, forced: bool = False) -> tuple[str | None, DataFrame]:
        """(first reason for a full rebuild or null, (relpath, action) of every file). files (relpath, sha, accession)."""
        sidecar = self.head_or_none()
        reason = None
        if forced:
            reason = "forced"
        elif sidecar is None:
            reason = "no_sidecar"
        elif not {"segments", "files", "gone", "gone_rows", "tables"} <= set(sidecar):
            reason = "bad_manifest"
        elif sidecar.get("recipe") != recipe:
            reason = "recipe_changed"
        else:
            try:
                if self.rows(sidecar).count() != sidecar.get("rows"):
                    reason = "row_count"
            except Exception as error:
                if getattr(error, "getCondition", lambda: None)() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                reason = "collection_missing"
        if reason:
            return reason, files.select("relpath", F.lit("add").alias("action"))
        return None, manifest_diff(self.files(sidecar), files)

    def update(
        self, chunks: DataFrame, files: DataFrame, recipe: dict, sha: str, derive: Derive | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, forced: bool = False, indexed_at: str = ""
    ) -> Update:
        """Bring the store to ``files`` (relpath, sha, accession); ``chunks`` has the rows of all of them. ``prepare`` adds what an index
        needs, as tokens or embeddings; only rows of new and changed files get that far."""
        version = self.next_version()  # taken before anything is read: who commits it meanwhile makes this update a conflict
        listed = self.stage(files.select("relpath", "sha", "accession"), "files")  # digests are made once
        reason, actions = self.plan(self.read(listed), recipe, forced)
        actions = written(actions, "actions")
        sidecar = self.head_or_none() if reason is None else None
        changes = {r.action: r["count"] for r in actions.where("action <> 'unchanged'").groupBy("action").count().collect()}
        if reason is None and not changes:
            return Update(sidecar["version"], None, 0, 0)
        come = actions.where("action in ('add', 'replace')").select("relpath")
        if reason is None:
            chunks = chunks.join(small_side(come, changes.get("add", 0) + changes.get("replace", 0)), "relpath", "left_semi")
        segment = self.stage(prepare(chunks).withColumn(VERSION, F.lit(version).cast("long")), "segments")
        fresh, gone, gone_rows, left, segments, before = self.read(segment), None, 0, None, [segment], 0
        if reason is None:
            old = small_side(actions.where("action in ('replace', 'delete')").select("relpath"), changes.get("replace", 0) + changes.get("delete", 0))
            now_gone = self.files(sidecar).join(old, "relpath").select("accession", F.lit(version - 1).cast("long").alias("upto"))
            every = now_gone.unionByName(self.read(sidecar["gone"])) if sidecar["gone"] else now_gone
            gone = self.stage(every.groupBy("accession").agg(F.max("upto").alias("upto")), "gone")
            now_gone, gone_rows = self.read(gone).where(F.col("upto") == version - 1).select("accession"), self.read(gone).count()
            left = self.rows(sidecar).join(small_side(now_gone, gone_rows), "accession", "left_semi")
            segments, before = [*sidecar["segments"], segment], sidecar["rows"]
        made = derive(self.tables(sidecar) if sidecar else {}, fresh, left) if derive else {}
        tables = {name: self.stage(df, f"tables/{name}") for name, df in made.items()}
        now = {"version": version, "sha": sha, "recipe": recipe, "indexed_at": indexed_at, "segments": segments, "gone": gone, "gone_rows": gone_rows, "files": listed, "tables": tables}
        added = fresh.count()
        rows = self.rows(now).count()
        self.commit(version, {**now, "rows": rows})
        return Update(version, reason, added, before + added - rows)

    def compact(self) -> int:
        """Write the live rows as one segment without deletions; the rows keep their versions. Returns the new version."""
        version, sidecar = self.next_version(), self.head()
        segment = self.stage(self.rows(sidecar), "segments")
        self.commit(version, {**sidecar, "version": version, "segments": [segment], "gone": None, "gone_rows": 0})
        return version
