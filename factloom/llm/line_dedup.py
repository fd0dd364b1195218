"""Line deduplication by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its ``DEPTH`` leading tokens, in which variable fields (tokens with
digits, @ or /) are wildcards, to a leaf. In a leaf it has five templates: the sequence of its four quarters, and the four
sequences in which one quarter is a wildcard; so lines of one leaf that differ in one part share a template. The rule is the
same for every length; a quarter of a short line may be empty.

A template is recurring if it stands in at least ``MIN_TEXTS`` texts that are no copies of each other (``MIN_TEXTS_PASSAGE``
for a passage of ``PASSAGE_TOKENS`` or more), whatever stands around it; all lines of recurring templates are dropped, so a
notice of several lines goes whole. Copied documents are not this operator's task (see ``near_dup``): equal texts and near
copies make one class, and a template counts its different classes exactly. Near copies are the connected components over
pairs of texts whose MinHash signatures agree in ``NEAR`` of their places. Signatures are taken on word pairs, as scattered
edits spoil longer shingles while a shared passage weighs the same: copies that edits leave with half of their five-word
shingles still have three quarters of their pairs. A text of which one shared passage is the greater part counts as a copy.

Scale: a line is one row of hashes, whatever its length; only lines whose leaf has lines of another text go on; counts
combine before they are shuffled, first by template and class, so neither a hot template nor a large class lands in one
task; joins with tables of unique keys are broadcast if these are few (they are counted), otherwise only the hot keys are.

Nulls and edge cases: a null text stays null and an empty one empty; blank lines are never dropped; if all lines of a text
are dropped it becomes empty, the row stays; texts without a recurring line keep their bytes; results depend on the texts
alone, so order, ties and a null or repeated ``doc_id`` need no care. Columns of ``docs`` pass through; internal ones start
with ``_line_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, keyed_join, small_side, text_batches, text_slices, word_hashes
from factloom.llm.near_dup import connected_components

#: Different texts in which a template must stand.
MIN_TEXTS = 5
#: The same for a passage of ``PASSAGE_TOKENS`` or more.
PASSAGE_TOKENS = 50
MIN_TEXTS_PASSAGE = 2
DEPTH = 3
PARTS = 4
#: Letters that make a token a variable field.
MARKED = b"0123456789@/"
#: Places of a signature, and how many of them one band takes.
PLACES = 30
BAND = 3
#: Share of equal places from which on two texts are near copies.
NEAR = 0.55
#: Bytes of positions to drop up to which they are broadcast to the documents.
BROADCAST_BYTES = 48_000_000

KEYS = [f"_line_k{i}" for i in range(PARTS + 1)]
_LINES = "_line_a long, _line_b int, pos int, tokens int, leaf long, " + "".join(f"{k} long, " for k in KEYS) + "signature array<int>"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WILD = np.uint64(0xA0761D6478BD642F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Lines:
    """Templates of all non-blank lines of some texts, as arrays with one entry a line; tokens end at ASCII white space."""

    def __init__(self, texts: list[str]):
        data = "\n".join(texts).encode("utf-8", "replace")
        begin = np.cumsum([0] + [len(t.encode("utf-8", "replace")) + 1 for t in texts[:-1]])  # of each text
        units = np.frombuffer(data, np.uint8)
        starts, hashes, marked = word_hashes(units, MARKED)
        breaks = np.cumsum(units == 10)
        line = breaks[starts]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        self.hashes = np.where(marked, _WILD, hashes)
        self.starts, self.ends = first, np.append(first[1:], len(line))
        self.n = self.ends - self.starts
        self.owner = np.searchsorted(begin, starts[first], "right") - 1
        before = np.where(begin > 0, breaks[np.maximum(begin, 1) - 1], 0) if len(units) else np.zeros(len(begin), np.int64)
        self.pos = (line[first] - before[self.owner]).astype(np.int32)
        with np.errstate(over="ignore"):
            self._templates()

    def _templates(self) -> None:
        size = len(self.hashes)
        # hash of words s to e: sum of hash[i] * odd ** (i - s), from running sums and the inverse of odd modulo 2 ** 64
        up, down = np.full(size + 1, _ODD), np.full(size + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * up[:size], dtype=np.uint64)])
        span = lambda s, e: (sums[e] - sums[s]) * down[s]
        leaf = _mixed(span(self.starts, self.starts + np.minimum(self.n, DEPTH)) + self.n.astype(np.uint64) * _WILD)
        cuts = [self.starts + self.n * i // PARTS for i in range(PARTS + 1)]
        parts = [_mixed(span(a, b) + np.uint64(i + 1)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        whole = leaf + np.sum(parts, axis=0, dtype=np.uint64) if len(leaf) else leaf
        self.leaf = leaf.view(np.int64)
        self.keys = [_mixed(whole).view(np.int64)] + [_mixed(whole - p + _WILD * np.uint64(i + 1)).view(np.int64) for i, p in enumerate(parts)]

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """(first line of each text that has one, MinHash signature of the text's word pairs)."""
        if not len(self.n):
            return np.empty(0, np.int64), np.empty((0, PLACES), np.int32)
        first = np.flatnonzero(np.diff(self.owner, prepend=-1))
        begin = self.starts[first]
        out = np.empty((len(first), PLACES), np.int32)
        with np.errstate(over="ignore"):
            # a text's last word makes a pair with its first one
            following = np.append(self.hashes[1:], np.uint64(0))
            following[np.append(begin[1:], len(self.hashes)) - 1] = self.hashes[begin]
            pairs = _mixed(self.hashes * _ODD + following)
            for k in range(PLACES):
                out[:, k] = np.minimum.reduceat((pairs * np.uint64(2 * (k + 1) * 0x9E3779B1 + 1) * _MIX) >> np.uint64(33), begin)
        return first, out


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, a, b = (batch.column(c).to_pylist() for c in ("text", "_line_a", "_line_b"))
        for part in text_slices(texts):
            yield _record(list(zip(a[part], b[part], texts[part], strict=True)))


def _record(held: list[tuple[int, int, str]]) -> pa.RecordBatch:
    lines = Lines([t for _, _, t in held])
    first, signatures = lines.signatures()
    offsets = np.zeros(len(lines.n) + 1, np.int32)
    offsets[first + 1] = PLACES
    ids_a, ids_b = np.array([a for a, _, _ in held], np.int64), np.array([b for _, b, _ in held], np.int32)
    columns = [ids_a[lines.owner], ids_b[lines.owner], lines.pos, lines.n.astype(np.int32), lines.leaf, *lines.keys]
    columns = [pa.array(c) for c in columns] + [pa.ListArray.from_arrays(np.cumsum(offsets, dtype=np.int32), signatures.ravel())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _LINES.split(", ")])


def near_copy_classes(signed: DataFrame) -> DataFrame:
    """(node, component) of the texts (_line_a, signature) that have near copies."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(PLACES // BAND - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * BAND + 1, BAND)))
    banded = signed.select("_line_a", F.explode(bands).alias("band"))
    least = banded.groupBy("band").agg(F.min("_line_a").alias("least"), F.max("_line_a").alias("most"), F.count("*").alias("n")).where("least < most").select("band", "least", "n")
    met = keyed_join(banded, checkpoint(least), "band", "n").where("_line_a <> least").select("_line_a", "least").distinct()
    of = lambda name: signed.groupBy(F.col("_line_a").alias(name)).agg(F.min("signature").alias(f"of_{name}"))
    pairs = met.join(of("_line_a"), "_line_a").join(of("least"), "least")
    equal = F.aggregate(F.zip_with("of__line_a", "of_least", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    return connected_components(pairs.where(equal >= NEAR * PLACES).select(F.col("_line_a").alias("a"), F.col("least").alias("b")))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(_line_a, _line_b, _line_drop): for a text's two hashes the positions of its lines of recurring templates."""
    text_batches(docs.sparkSession)
    source = docs.where("text is not null and text <> ''").select(F.xxhash64("text").alias("_line_a"), F.hash("text").alias("_line_b"), "text")
    lines = checkpoint(source.mapInArrow(_line_rows, _LINES))
    leaves = lines.groupBy("leaf").agg(F.min("_line_a").alias("x"), F.max("_line_a").alias("y"), F.count("*").alias("n")).where("x < y").select("leaf", "n")
    met = keyed_join(lines.drop("signature"), checkpoint(leaves), "leaf", "n").drop("leaf").distinct()  # copies of a text count once
    classes = near_copy_classes(lines.where(F.size("signature") > 0).select("_line_a", "signature"))
    classed = met.join(small_side(classes.withColumnRenamed("node", "_line_a"), classes.count()), "_line_a", "left")
    shared = checkpoint(classed.withColumn("component", F.coalesce("component", "_line_a")))
    keyed = shared.select("_line_a", "_line_b", "pos", "tokens", "component", F.explode(F.array(*KEYS)).alias("key"))
    stands = keyed.groupBy("key", "tokens", "component").agg(F.count("*").alias("n")).groupBy("key", "tokens").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    enough = F.when(F.col("tokens") >= PASSAGE_TOKENS, MIN_TEXTS_PASSAGE).otherwise(MIN_TEXTS)
    recurring = checkpoint(stands.where(F.col("texts") >= enough).select("key", "n"))
    dropped = keyed_join(keyed.select("_line_a", "_line_b", "pos", "key"), recurring, "key", "n")
    return checkpoint(dropped.groupBy("_line_a", "_line_b").agg(F.array_sort(F.collect_set("pos")).alias("_line_drop")))


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``text`` cleaned, ``_line_n`` lines before and ``_line_dropped`` lines dropped."""
    drop = recurring_lines(docs)
    size = drop.agg(F.sum(F.size("_line_drop") * 4 + 64)).first()[0] or 0
    keyed = docs.withColumns({"_line_a": F.xxhash64("text"), "_line_b": F.hash("text")})
    joined = keyed.join(small_side(drop, size, BROADCAST_BYTES), ["_line_a", "_line_b"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("_line_drop"), i)), "\n")
    dropped = F.when(F.col("text").isNull(), None).otherwise(F.coalesce(F.size("_line_drop"), F.lit(0)))
    out = joined.withColumns({"_line_n": F.size(lines), "_line_dropped": F.when(F.col("_line_drop").isNull(), F.lit(0)).otherwise(dropped)})
    out = out.withColumn("text", F.when(F.col("_line_drop").isNull(), F.col("text")).otherwise(kept))
    return out.select(*docs.columns, "_line_n", "_line_dropped")
