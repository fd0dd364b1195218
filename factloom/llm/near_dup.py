"""Near-duplicate detection on word shingles with bottom-k sketches.

One hash function orders all shingles, and the ``k`` smallest of a document are its sketch. Inverted lists of the retained
values bring documents together, the sketch of a union of two documents estimates their similarity, and full sets
confirm it.

Scale. Equal sets collapse into one class first, so a group of copies costs one sketch. Two sets of similarity ``t`` share
``need(n)`` retained values at least (but for a chance of about 1e-8), so it is enough to look a document up by its
``k - need + 1`` rarest retained values: any two such sketches meet in one of these. Values that one document alone holds
fill most of these places, so passages that many documents share make no candidates. Lists are linked as stars (each
member to the smallest one), never as pairs. The groups that come out are dealt to blocks of bounded size: first each member
is compared with its block and with the group's hub (its smallest member), which settles groups of copies with one copy of
each set; only what this leaves apart is compared across blocks, and what is linked already never with each other. A block
returns a star for what its confirmed links connect, not all links. Joins on
values or nodes that may be hot take these apart.

Nulls and edge cases: a null or empty text has no shingles and is linked with nothing; a text of 1 to 4 words is one
shingle; a row whose ``doc_id`` is null is linked with nothing, its component is null and it is kept; repeated rows of one
``doc_id`` give one result row each and are one document, which is linked by any of its texts. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, keyed_join, small_side, text_batches, text_slices, word_hashes, written

SHINGLE_WORDS = 5
SKETCH = 48
#: Two full sketches share at least ``SKETCH * (t - SLACK)`` values if the similarity is ``t`` (all but 1e-8 of such pairs).
SLACK = 0.36
#: Sets that a block holds about, and shingles.
BLOCK = 1_024
BLOCK_SHINGLES = 2_000_000
#: Bits of a dense incidence matrix that a block pair holds at once.
MATRIX_CELLS = 4_000_000
#: Pairs whose unions are sketched at once.
PAIRS_AT_ONCE = 20_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its distinct 5-word shingles, A-Z lower-cased, words split at ASCII white space."""
    for part in text_slices(texts):
        data = [(t or "").encode("utf-8", "replace") for t in texts[part]]
        starts, hashes, _ = word_hashes(np.frombuffer(b"\n".join(data), np.uint8), lower=True)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)]))
        rolled = _rolled(hashes, SHINGLE_WORDS)
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            yield np.unique(rolled[lo : hi - SHINGLE_WORDS + 1]) if hi - lo >= SHINGLE_WORDS else _rolled(hashes[lo:hi], hi - lo)[:1]


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    count = len(hashes) - width + 1
    if count < 1 or not width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = hashes[:count] + np.uint64(width)
        for i in range(1, width):
            rolled = (rolled ^ (rolled >> np.uint64(29))) * _MULTIPLIER + hashes[i : i + count]
        rolled = (rolled ^ (rolled >> np.uint64(31))) * _MIX
        return rolled ^ (rolled >> np.uint64(30))


def _set_key(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, sizes, sketches = [], [], []
        for found in shingle_sets(batch["text"].tolist()):
            sizes.append(len(found))
            keys.append(_set_key(found))
            sketches.append(found[:SKETCH].view(np.int64).copy())  # a view would keep the whole set
        yield pd.DataFrame({"doc_id": batch["doc_id"], "set_key": keys, "n_shingles": sizes, "sketch": sketches})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop(columns="text").assign(shingles=[s.tobytes() for s in shingle_sets(batch["text"].tolist())])


def needs(percent: int) -> tuple[int, float]:
    """Retained values that a set shares at least with any set similar to it: a number for sets above the sketch's size
    and a share of its size for one that fits into its sketch (the other set is at most ``1/t`` times as large)."""
    t = percent / 100
    return int(np.ceil(SKETCH * (t - SLACK))), 2 - 1 / t


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) with ids; component is the smallest node.

    Alternating large and small stars: every round links each node's neighbours to its smallest one, until no
    edge changes. A round aggregates with map-side sums and is written to the checkpoint folder. Edges are written as a table:
    a checkpoint keeps the planner's estimate of its size, which is a product in each join, so two joins a round would
    multiply the digits of that number by four in every round until the driver can't hold it.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = count, _ = _state(edges)
    for _ in range(rounds if count else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = keyed_join(both.where("b > a"), least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpoint(large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        lowest = checkpoint(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = keyed_join(large, lowest, "a", "n").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct())
        seen, state = state, _state(edges)
        count = state[0]
        if state == seen:
            break
    else:
        if count:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them that tells whether they changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _links(percent: int):
    """Confirmed links between sets of different parts in a block, or between the sides of a pair of blocks, as stars."""
    full, share = needs(percent)

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["doc_id", "shingles"]).sort_values(["doc_id", "shingles"])
        ids, part, side = group["doc_id"].to_numpy(), group["part"].to_numpy(), group["side"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in group["shingles"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        asked = (part[:, None] != part[None, :]) & (ids[:, None] != ids[None, :])
        if (side != side[0]).any():
            asked &= side[:, None] != side[None, :]
        # the union's sketch holds no more common values than both sketches share, so what shares fewer needs no estimate
        least = np.where(sizes > SKETCH, full, np.ceil(sizes * share - 1e-9))
        sketches = [s[:SKETCH] for s in sets]
        asked &= _intersections(sketches) >= np.maximum(least[:, None], least[None, :])
        left, right = np.nonzero(np.triu(asked))
        common, size = _union_sketches(sketches, left, right)
        enough = np.where(size < SKETCH, 100 * common >= percent * size, common >= full)  # a union below the sketch's size is known whole
        asked[left[~enough], right[~enough]] = asked[right[~enough], left[~enough]] = False
        some = np.flatnonzero(asked.any(axis=1))
        if not len(some):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        ids, sizes, asked = ids[some], sizes[some], asked[np.ix_(some, some)]
        shared = _intersections([sets[i] for i in some])
        linked = asked & (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared))
        # each set takes the smallest label next to it until none changes
        np.fill_diagonal(linked, True)
        labels, before = np.arange(len(ids)), None
        while before is None or (labels != before).any():
            before = labels
            labels = np.where(linked, labels[None, :], len(ids)).min(axis=1)
            labels = labels[labels]
        apart = labels != np.arange(len(ids))
        return pd.DataFrame({"a": ids[apart], "b": ids[labels[apart]]}).astype("int64")

    return confirm


def _union_sketches(sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sets, given by their places: the ``SKETCH`` smallest values of the union are merged from both sketches; returns how
    many of these both sets hold, which over their number estimates the similarity, and that number."""
    none = np.uint64(2**64 - 1)
    padded = np.full((len(sketches), SKETCH), none, np.uint64)
    for i, sketch in enumerate(sketches):
        padded[i, : len(sketch)] = sketch
    common, size = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for at in range(0, len(left), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        merged = np.sort(np.concatenate([padded[left[part]], padded[right[part]]], axis=1), axis=1)
        again = np.zeros(merged.shape, bool)
        again[:, 1:] = merged[:, 1:] == merged[:, :-1]
        rank = np.cumsum(~again & (merged != none), axis=1)  # place among the distinct values
        common[part] = (again & (merged != none) & (rank <= SKETCH)).sum(axis=1)
        size[part] = np.minimum(rank[:, -1], SKETCH)
    return common, size


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over slices of the values that two sets share."""
    n = len(sets)
    shared = np.zeros((n, n), np.int64)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    values, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    np.fill_diagonal(shared, [len(s) for s in sets])
    keep = counts[columns] > 1
    rows, columns = rows[keep], columns[keep]
    if not len(columns):
        return shared
    columns = np.unique(columns, return_inverse=True)[1]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    width = max(1, MATRIX_CELLS // n)
    total = np.zeros((n, n), np.float64)
    for start in range(0, int(columns[-1]) + 1, width):
        lo, hi = np.searchsorted(columns, [start, start + width])
        part = np.zeros((n, int(min(width, columns[-1] + 1 - start))), np.float32)
        part[rows[lo:hi], columns[lo:hi] - start] = 1
        total += part @ part.T
    np.fill_diagonal(total, 0)
    return shared + total.astype(np.int64)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept.

    Two documents are linked if ``100 * intersection >= percent * union`` of their shingle sets.
    """
    text_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = checkpoint(source.mapInPandas(_sketches, "doc_id long, set_key binary, n_shingles long, sketch array<long>"))
    usable = sketched.where("doc_id is not null and set_key is not null")
    classes = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("c"), F.count("*").alias("copies")).select("set_key", "copies", "c.*")
    classes = checkpoint(classes)

    # one number tells texts of a doc_id apart and holds how many values of a sketch must be shared at least
    full, share = needs(percent)
    least = F.when(F.col("n_shingles") > SKETCH, F.lit(full)).otherwise(F.ceil(F.col("n_shingles") * share - 1e-9)).cast("long")
    tag = F.shiftleft(F.hash("set_key").cast("long"), 8) + least
    retained = classes.select("doc_id", tag.alias("tag"), F.explode("sketch").alias("value"))
    lists = checkpoint(retained.groupBy("value").agg(F.count("*").alias("length")).where("length > 1"))
    shared = keyed_join(retained, lists.withColumn("n", F.col("length")), "value", "n")
    asked = shared.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("length", "value"))).alias("shared"))
    places = F.size("shared") - F.col("tag").bitwiseAND(F.lit(255)).cast("int") + 1  # values that no other document holds have taken the first places
    probes = asked.select("doc_id", F.explode(F.slice("shared", F.lit(1), F.greatest(places, F.lit(0)))).alias("p")).select("doc_id", "p.value")
    probes = checkpoint(probes)
    hubs = checkpoint(probes.groupBy("value").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("value", "least", "n"))
    stars = keyed_join(probes, hubs, "value", "n").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    groups = connected_components(stars)

    links = _confirmed(source, groups, classes.select("doc_id", "n_shingles"), percent)
    copied = classes.where("copies > 1").select("set_key", "copies", F.col("doc_id").alias("class_id"))
    members = keyed_join(usable.select("doc_id", "set_key"), copied, "set_key", "copies").select("doc_id", "class_id").distinct()
    members = checkpoint(members.unionByName(classes.where("copies = 1").select("doc_id", F.col("doc_id").alias("class_id"))))
    # texts of one doc_id belong together
    several = members.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("most")).where("b < most")
    merged = connected_components(links.unionByName(members.join(several, "doc_id").select(F.col("class_id").alias("a"), "b")))
    linked = members.join(small_side(merged.withColumnRenamed("node", "class_id"), merged.count()), "class_id", "left").select("doc_id", F.least(F.col("class_id"), F.col("component")).alias("found"))
    found = linked.groupBy("doc_id").agg(F.min("found").alias("found"))
    out = sketched.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _confirmed(source: DataFrame, groups: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside the candidate groups that full shingle sets confirm; enough of them to connect what is linked."""
    known = sizes.groupBy("doc_id").agg(F.sum("n_shingles").alias("n")).join(small_side(groups.withColumnRenamed("node", "doc_id"), groups.count()), "doc_id")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    # members are dealt to blocks by hash: no ranking of a large group in one task
    placed = known.select("doc_id", "component").join(known.groupBy("component").agg(blocks), "component")
    placed = checkpoint(placed.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    texts = source.where("doc_id is not null").join(small_side(placed, placed.count()), "doc_id").select("doc_id", "component", "blocks", "side", "text")
    sets = checkpoint(texts.mapInPandas(_sets, "doc_id long, component long, blocks int, side int, shingles binary"))

    several = F.sequence(F.lit(0), F.col("blocks") - 1)
    hubs = sets.where("doc_id = component").select("doc_id", "component", F.explode(several).alias("block"), "shingles")
    first = sets.select("doc_id", "component", F.col("side").alias("block"), "shingles").unionByName(hubs)
    first = first.withColumns({"part": F.col("doc_id"), "side": F.lit(0)})
    links = checkpoint(first.groupBy("component", "block").applyInPandas(_links(percent), "a long, b long"))
    return links.unionByName(_across(sets.where("blocks > 1"), placed.where("blocks > 1"), links, percent))


def _across(sets: DataFrame, placed: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between members of one group that ``links`` have left in different parts.

    The largest part of a group is its core. Other members meet each other and the core in pairs of blocks; members of the
    core never meet each other.
    """
    merged = connected_components(links).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "part")
    parted = placed.join(small_side(merged, merged.count()), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id")).select("doc_id", "component", "blocks", "part")
    counts = parted.groupBy("component", "blocks", "part").agg(F.count("*").alias("members"))
    whole = counts.groupBy("component", "blocks").agg(F.max(F.struct("members", "part")).alias("core"), F.sum("members").alias("members")).where(F.col("core.members") < F.col("members"))
    share = lambda n: F.greatest(F.lit(1), F.ceil(F.col("blocks") * n / F.col("members"))).cast("int")
    whole = whole.select("component", F.col("core.part").alias("core"), share(F.col("members") - F.col("core.members")).alias("apart"), share(F.col("core.members")).alias("cores"))
    met = parted.drop("blocks").join(whole, "component")
    inside = F.col("part") == F.col("core")
    met = met.withColumn("side", F.when(inside, F.col("apart") + F.pmod(F.xxhash64("doc_id"), F.col("cores"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("apart"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(inside, F.col("apart") - 1).otherwise(F.col("apart") + F.col("cores") - 1))
    met = met.withColumn("others", others).select("doc_id", "part", "side", "others")
    pairs = sets.select("doc_id", "component", "shingles").join(met, "doc_id").select("doc_id", "component", "part", "side", "shingles", F.explode("others").alias("other"))
    pairs = pairs.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")})
    return pairs.groupBy("component", "lo", "hi").applyInPandas(_links(percent), "a long, b long")
