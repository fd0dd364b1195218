"""A trace log that each record enters exactly once.

A stream's micro-batch is written to a folder named by the stream and the batch's number, then named by a version file of that
number. Spark hands out the same records for the same number when it starts again after a failure, so a batch that was
written and not yet noted is written over, one that was committed is left alone, and readers see whole batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from factloom.sources.versions import Conflict, VersionedFolder


class TraceLog(VersionedFolder):
    """``path``: a folder of one stream's log. Batch n is version n."""

    def batch_folder(self, batch: int) -> str:
        return f"{self.path}/batches/{batch:012d}"

    def write(self, records: DataFrame, batch: int) -> bool:
        """Write a batch as a whole; false if it is in the log already."""
        if batch in self.versions():
            return False
        records.write.mode("overwrite").parquet(self.batch_folder(batch))  # over what a failed attempt has left
        try:
            self.commit(batch, {"batch": batch})
        except Conflict:
            return False
        return True

    def records(self, schema: StructType) -> DataFrame:
        """All committed records with the number of their ``batch``."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        rows = self.spark.read.schema(schema).parquet(*(self.batch_folder(b) for b in found)).select("*", F.col("_metadata.file_path").alias("_file"))
        return rows.withColumn("batch", F.regexp_extract("_file", r"/batches/(\d+)/", 1).cast("long")).drop("_file")


def log_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what a stream has now into the log at ``path`` and stop."""
    spark: SparkSession = records.sparkSession
    log = TraceLog(spark, path)
    return records.writeStream.foreachBatch(lambda batch, number: log.write(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
