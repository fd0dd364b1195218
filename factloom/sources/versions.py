"""Small version files that make what writers have staged visible: each appears by a rename that fails if it is there already."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class VersionedFolder:
    """A folder whose state is the newest file under ``versions``; all that it names was written before it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _java(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{name}".rstrip("/"))
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        return path, path.getFileSystem(conf), conf

    def versions(self) -> list[int]:
        folder, fs, _ = self._java("")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def next_version(self) -> int:
        return (self.versions() or [0])[-1] + 1

    def state(self, version: int | None = None) -> object:
        """What a version file holds, the newest unless given; null if there is none. A file that is no JSON is a ValueError."""
        found = [version] if version is not None else self.versions()
        return json.loads(self.spark.read.text(f"{self.path}/versions/{found[-1]:012d}.json", wholetext=True).first().value) if found else None

    def commit(self, version: int, state: dict) -> None:
        target, fs, conf = self._java(f"{version:012d}.json")
        staged = self._java(f".{uuid.uuid4().hex}")[0]
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # none: a target that exists is an error
        try:
            context.rename(staged, target, options)
        except Exception as error:
            fs.delete(staged, False)
            if fs.exists(target):
                raise Conflict(f"{self.path}: version {version} is there already") from error
            raise

    def read(self, *names: str):
        return self.spark.read.parquet(*(f"{self.path}/{n}" for n in names))

    def stage(self, df, kind: str) -> str:
        """Write ``df`` under a new name, which no one reads until a version names it."""
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name
