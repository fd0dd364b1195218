"""Line-oriented JSON: strict scans that name the bad line, and reports in two shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.sources.shared import written


#: Rows of a table of splits that may be broadcast.
BROADCAST_SPLITS = 400_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1 in each file.

    A file may be read by many tasks. One pass counts the lines of each split, the sums over the splits before give where a
    split begins, and a line's number is that plus its place in the split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = written(lines.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")), "splits")
    ahead = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = splits.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    if starts.count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    return lines.join(starts, ["file", "_start"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def line_problem(value: Column, row: Column, required: tuple[str, ...] = (), blank_is_fine: bool = False) -> Column:
    """What is wrong with a line, or null; ``row``: the line as parsed."""
    problem = F.when(F.trim(value) == "", F.lit(None).cast("string") if blank_is_fine else F.lit("blank line"))
    problem = problem.when(~F.is_valid_utf8(value), "bytes that are not UTF-8").when(F.try_parse_json(value).isNull() | row.isNull(), "malformed JSON")
    missing = F.filter(F.array(*(F.when(row[name].isNull(), F.lit(name)) for name in required)), lambda x: x.isNotNull()) if required else F.array().cast("array<string>")
    return problem.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))


def bad_lines(spark: SparkSession, path: str, schema: StructType | str, required: tuple[str, ...] = (), blank_is_fine: bool = False) -> DataFrame:
    """(file, line, problem, value) of the lines that ``read_strict`` would not take."""
    told = numbered_lines(spark, path).withColumn("_r", F.from_json("value", schema))
    return told.withColumn("problem", line_problem(F.col("value"), F.col("_r"), required, blank_is_fine)).where("problem is not null").select("file", "line", "problem", "value")


def read_strict(spark: SparkSession, path: str, schema: StructType | str, required: tuple[str, ...] = (), blank_is_fine: bool = False, numbered: bool = False) -> DataFrame:
    """Rows of JSON-lines files; a blank line (unless it is fine, then it is skipped), a malformed one, bytes that are not UTF-8 and
    a missing required field are errors that name file and line. ``numbered`` adds file and line to the rows."""
    parsed = numbered_lines(spark, path).withColumn("_r", F.from_json("value", schema))
    parsed = parsed.withColumn("_problem", line_problem(F.col("value"), F.col("_r"), required, blank_is_fine))
    bad = F.raise_error(F.concat(F.lit("in "), F.col("file"), F.lit(" line "), F.col("line").cast("string"), F.lit(": "), F.col("_problem"), F.lit(": "), F.substring("value", 1, 80)))
    checked = parsed.withColumn("_line", F.when(F.col("_problem").isNull(), F.col("value")).otherwise(bad.cast("string")))
    if blank_is_fine:
        checked = checked.where(F.trim("_line") != "")
    # the checked text takes part in the result, so the check can't be pruned away
    return checked.select(F.from_json("_line", schema).alias("r"), "file", "line").select("r.*", *(["file", "line"] if numbered else []))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report, ord, raw, provenance) of report files: a bare list of results or an object with ``results``."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("report"), F.parse_json("value").alias("v"))
    bare = F.schema_of_variant("v").startswith("ARRAY")
    rows = F.when(bare, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", "$.results", "array<variant>"))
    return files.select("report", F.when(~bare, F.try_variant_get("v", "$.provenance", "variant")).alias("provenance"), F.posexplode(rows).alias("ord", "raw"))


def has_key(raw: str, key: str):
    """Whether a field stands in an object, be it null: absent and null are different."""
    return F.array_contains(F.json_object_keys(F.to_json(F.col(raw))), key)
