"""Many strings looked up in many texts in one pass: each task reads its texts through one automaton of all strings.

Texts are never shuffled and nothing compares a text with one string at a time, so a string whose words are common costs no more than a
rare one. An automaton takes ``AUTOMATON_BYTES`` of strings at most; more strings are dealt to several automata, and each takes a
pass over the texts. What leaves a task is one row for each string that a text holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.batch import small_batches

AUTOMATON_BYTES = 16_000_000
#: Characters around a hit that a snippet shows.
CONTEXT = 60


def _scan(needles, context: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for needle, number in needles.value.items():
            automaton.add_word(needle, (number, len(needle)))
        automaton.make_automaton()
        for batch in batches:
            at, numbers, starts, snippets = [], [], [], []
            for i, text in enumerate(batch["_text"]):
                text, first = text.as_py(), {}
                if text:
                    for end, (number, length) in automaton.iter(text):
                        first.setdefault(number, (end - length + 1, end + 1))
                for number, (start, end) in first.items():
                    at.append(i)
                    numbers.append(number)
                    starts.append(start)
                    snippets.append(text[max(0, start - context) : end + context])
            columns = [batch[c].take(pa.array(at, pa.int32())) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(snippets, pa.string())], [*kept, "_number", "start", "snippet"])

    return run


def occurrences(docs: DataFrame, needles: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The columns of needles (needle and any others) and of docs (text and any others but those names) for each needle that a text
    contains, with the first place of it (``start``, from 0) and a ``snippet``. A null or empty needle or text is in nothing."""
    wanted = needles.where("needle <> ''")
    size = wanted.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    shards = -(-size // AUTOMATON_BYTES)
    kept = [c for c in docs.columns if c != "text"]
    schema = docs.select(*kept, F.lit(0).alias("_number"), F.lit(0).alias("start"), F.lit("").alias("snippet")).schema
    spark, out = docs.sparkSession, None
    small_batches(spark)
    for shard in range(max(1, shards)):
        texts = wanted.where(F.pmod(F.xxhash64("needle"), F.lit(shards)) == shard) if shards > 1 else wanted
        numbered = {r.needle: i for i, r in enumerate(texts.select("needle").distinct().collect())}  # about AUTOMATON_BYTES
        found = docs.select(*kept, F.col("text").alias("_text")).mapInArrow(_scan(spark.sparkContext.broadcast(numbered), context, kept), schema)
        names = spark.createDataFrame(list(numbered.items()), "needle string, _number int")
        found = found.join(F.broadcast(names), "_number").drop("_number")
        out = found if out is None else out.unionByName(found)
    return out.join(wanted, "needle")
