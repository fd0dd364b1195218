"""Phrase collocations per language from exact counts in mergeable counting quotient filters.

Words get 64-bit ids, which are proved to be unique within a language over its whole vocabulary (else all are dealt anew with
another seed). The ids of an n-gram, packed side by side, are permuted invertibly; the leading bits of what comes out are the quotient,
the rest is the remainder, which is kept in full, so a counter never stands for two n-grams and the ids can be read back. A
filter holds its remainders sorted by quotient with the length of each quotient's run, and counters of one byte with escapes.
Filters of different tasks are merged by quotient range ("shard").

A phrase of n words is as frequent as ``least`` only if its words and both phrases of n - 1 words in it are. So there is
one pass over the texts for each length, which counts an n-gram only where both parts may be frequent; that is told by a bit
table of fixed size over the frequent parts, which may let others through but never loses one. So what is shuffled is little
more than the frequent phrases, whatever the corpus, and only the bit table is broadcast.

Scale. Words and n-grams are summed up in the workers before they are shuffled. The permutation spreads n-grams evenly over
shards, and their number follows the number of words, so neither a language nor a phrase makes a hot group. Joins of candidates with their
parts have unique keys on one side; the planner splits hot ones on the other.

Nulls and edge cases: a null text counts as empty, a null lang is ``und``; texts without words, and languages without candidates,
give no rows; repeated rows count each time; doc_id is not read, nor are other columns; memory is bounded by a batch of texts,
``HELD`` n-grams a worker and one shard. Ties are settled as the contract says; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, small_side, text_batches, text_slices, word_hashes

LONGEST = 4
#: Words of the corpus for each shard.
SHARD_WORDS = 1 << 22
#: N-grams that a worker holds before it sends its filters on.
HELD = 3_000_000
#: Distinct words that a worker holds before it sends them on.
HELD_WORDS = 300_000
#: Bits of the table that tells which parts may be frequent (8 MB).
TABLE_BITS = 26
SEEDS = 4

#: A-Z to lower case, and all that ends a piece as a line feed; a line feed also stands between texts.
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
_ODD = 0xD6E8FEB86659FD93
_ADD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all."""
    with np.errstate(over="ignore"):
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(_ODD)
        return x ^ (x >> np.uint64(32))


def _unmixed(x: np.ndarray) -> np.ndarray:
    back = np.uint64(pow(_ODD, -1, 1 << 64))
    with np.errstate(over="ignore"):
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * back
        return x ^ (x >> np.uint64(32))


def _folded(lanes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(lanes[0]), np.uint64)
    with np.errstate(over="ignore"):
        for j, lane in enumerate(lanes[1:], 1):
            out ^= _mixed(lane + np.uint64(j * _ADD % (1 << 64)))
    return out


def permuted(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The packed ids of n-grams, one array for each place, under an invertible permutation that spreads them over the first lane."""
    return [_mixed(ids[0] ^ _folded(ids)), *ids[1:]]


def unpermuted(lanes: list[np.ndarray]) -> list[np.ndarray]:
    return [_unmixed(lanes[0]) ^ _folded(lanes), *lanes[1:]]


def summed(lanes: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(counts):
        return lanes, counts
    order = np.argsort(lanes[0], kind="stable")
    differ = lambda lane: lane[order][1:] != lane[order][:-1]
    first, others = differ(lanes[0]), np.logical_or.reduce([differ(lane) for lane in lanes[1:]])
    if (others & ~first).any():
        order = np.lexsort(lanes[::-1])
        first = np.logical_or.reduce([differ(lane) for lane in lanes])
    starts = np.flatnonzero(np.concatenate([[True], first]))
    return [lane[order][starts] for lane in lanes], np.add.reduceat(counts[order], starts)


def to_bytes(lanes: list[np.ndarray], counts: np.ndarray, shard_bits: int) -> bytes:
    """A filter of one shard from distinct keys in order: the shard's bits are known, the next bits of the first lane are the
    quotient and stand as run lengths; what is left of it, the other lanes and the counters follow."""
    n = len(counts)
    bits = min(max(0, n.bit_length() - 1), 64 - shard_bits)
    rest = 64 - shard_bits - bits
    low = lanes[0] & np.uint64((1 << (64 - shard_bits)) - 1)
    quotients = (low >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(n, np.int64)
    runs = np.bincount(quotients, minlength=1 << bits)
    width = -(-rest // 8)
    remainders = (low & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    wide = np.flatnonzero(runs >= 255)
    large = np.flatnonzero(counts >= 255)
    head = np.array([n, bits, len(wide), len(large)], "<i8")
    parts = [
        head, np.minimum(runs, 255).astype(np.uint8), runs[wide].astype("<i8"), np.ascontiguousarray(remainders), *(lane.astype("<u8") for lane in lanes[1:]),
        np.minimum(counts, 255).astype(np.uint8), counts[large].astype("<i8"),
    ]
    return b"".join(p.tobytes() for p in parts)


def from_bytes(data: bytes, width_words: int, shard: int, shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(lanes, counts) of a filter, all bits restored."""
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, n, at)
        at += found.nbytes
        return found

    n, bits, n_wide, n_large = take("<i8", 4).tolist()
    runs = take(np.uint8, 1 << bits).astype(np.int64)
    runs[runs == 255] = take("<i8", n_wide)
    rest = 64 - shard_bits - bits
    width = -(-rest // 8)
    remainders = np.zeros((n, 8), np.uint8)
    remainders[:, :width] = take(np.uint8, n * width).reshape(n, width)
    first = remainders.view("<u8").ravel().astype(np.uint64)
    if rest < 64:
        first |= np.repeat(np.arange(1 << bits, dtype=np.uint64), runs) << np.uint64(rest)
    if shard_bits:
        first |= np.uint64(shard << (64 - shard_bits))
    lanes = [first, *(take("<u8", n).astype(np.uint64) for _ in range(width_words - 1))]
    counts = take(np.uint8, n).astype(np.int64)
    counts[counts == 255] = take("<i8", n_large)
    return lanes, counts


def spots(lang: str, ids: list[np.ndarray]) -> np.ndarray:
    """Places of n-grams of a language in the bit table."""
    own = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), "little"))
    return (_mixed(permuted(ids)[0] ^ own) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _by_language(batch: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
    """(lang, texts one after the other) of bounded runs of texts."""
    for lang, texts in batch.groupby("lang", sort=False)["text"]:
        texts = texts.tolist()
        for part in text_slices(texts, 4_000_000):
            yield lang, b"\n".join(t.encode("utf-8", "replace") for t in texts[part]).translate(_LETTERS)


def _words(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, data in _by_language(batch):
                held.setdefault(lang, Counter()).update(data.split())
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from sent(held)
                held = {}
        yield from sent(held)

    def sent(held: dict[str, Counter]) -> Iterator[pd.DataFrame]:
        for lang, counts in held.items():
            if counts:
                ids = word_hashes(np.frombuffer(b" ".join(counts), np.uint8), seed=seed)[1]
                yield pd.DataFrame({"lang": lang, "word": [w.decode("utf-8") for w in counts], "id": ids.view(np.int64), "n": list(counts.values()), "spot": spots(lang, [ids])})

    return run


def vocabulary(texts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, id, n, spot) of all words of ``texts`` (lang, text), and the seed under which their ids are unique in a language."""
    for seed in range(2024, 2024 + SEEDS):
        found = texts.mapInPandas(_words(seed), "lang string, word string, id long, n long, spot int")
        found = checkpoint(found.groupBy("lang", "word", "id", "spot").agg(F.sum("n").alias("n")))
        if found.groupBy("lang", "id").count().where("count > 1").isEmpty():
            return found, seed
    raise RuntimeError(f"word ids collide under {SEEDS} seeds")


def bit_table(frequent: DataFrame) -> np.ndarray:
    """A bit for the ``spot`` of each row; summed up in the tasks, at most 2 ** (TABLE_BITS - 6) rows come to the driver."""
    bits = frequent.groupBy(F.shiftright("spot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, spot & 63)")).alias("bits")).toArrow()
    out = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    out[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return out


def grams(data: bytes, lang: str, width: int, table: np.ndarray, seed: int) -> list[np.ndarray]:
    """Ids of the n-grams of ``width`` words within pieces, of which both parts of ``width - 1`` words are in the table."""
    units = np.frombuffer(data, np.uint8)
    starts, ids, _ = word_hashes(units, seed=seed)
    if len(ids) < width:
        return [np.empty(0, np.uint64)] * width
    piece = np.cumsum(units == 10, dtype=np.int32)[starts]
    part = width - 1
    at = spots(lang, [ids[j : len(ids) - part + 1 + j] for j in range(part)])
    known = (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    count = len(ids) - width + 1
    keep = np.flatnonzero(known[:count] & known[1 : count + 1] & (piece[:count] == piece[width - 1 :]))
    return [ids[keep + j] for j in range(width)]


def _filters(width: int, table, seed: int, shard_bits: int):
    """(lang, shard, filter) of the n-grams in a task's texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lang, data in _by_language(batch):
                lanes = permuted(grams(data, lang, width, table.value, seed))
                if len(lanes[0]):
                    held.setdefault(lang, []).append(summed(lanes, np.ones(len(lanes[0]), np.int64)))
                    size += len(held[lang][-1][1])
            if size > HELD:
                yield from sent(held)
                held, size = {}, 0
        yield from sent(held)

    def sent(held: dict[str, list]) -> Iterator[pd.DataFrame]:
        for lang, found in held.items():
            lanes, counts = summed([np.concatenate(x) for x in zip(*(f[0] for f in found), strict=True)], np.concatenate([f[1] for f in found]))
            shards = (lanes[0] >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(counts), np.int64)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            rows = [(lang, int(shards[a]), to_bytes([x[a:b] for x in lanes], counts[a:b], shard_bits)) for a, b in zip(edges, edges[1:], strict=False)]
            yield pd.DataFrame(rows, columns=["lang", "shard", "filter"])

    return run


def _merged(width: int, least: int, shard_bits: int):
    """(lang, ids, f, spot) of what is frequent in a shard, of all filters of which the sum is taken."""

    def run(key: tuple, filters: pa.Table) -> pa.Table:
        lang, shard = (k.as_py() for k in key)
        found = [from_bytes(f.as_py(), width, shard, shard_bits) for f in filters["filter"]]
        lanes, counts = summed([np.concatenate(x) for x in zip(*(f[0] for f in found), strict=True)], np.concatenate([f[1] for f in found]))
        often = counts >= least
        ids = unpermuted([lane[often] for lane in lanes])
        flat = np.stack(ids, axis=1).view(np.int64).ravel()
        arrays = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, dtype=np.int32), flat)
        return pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(arrays)), "ids": arrays, "f": counts[often], "spot": pa.array(spots(lang, ids) if len(arrays) else [], pa.int32())})

    return run


def phrase_counts(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """((lang, ids, f) of all phrases of 1 to 4 words with f >= least, (lang, word, id, n) of all words)."""
    text_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, seed = vocabulary(texts)
    total = words.agg(F.sum("n")).first()[0] or 0
    shard_bits = max(0, (total // SHARD_WORDS).bit_length())
    frequent = words.where(F.col("n") >= least).select("lang", F.array("id").alias("ids"), F.col("n").alias("f"), "spot")
    found = [frequent]
    for width in range(2, LONGEST + 1):
        table = docs.sparkSession.sparkContext.broadcast(bit_table(found[-1]))
        filters = texts.mapInPandas(_filters(width, table, seed, shard_bits), "lang string, shard int, filter binary")
        counted = filters.groupBy("lang", "shard").applyInArrow(_merged(width, least, shard_bits), "lang string, ids array<long>, f long, spot int")
        found.append(checkpoint(counted))
        table.unpersist()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.drop("spot"), words


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2_000) -> DataFrame:
    """Each lang's ``top`` phrases of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score."""
    counts, words = phrase_counts(docs, least)
    counts = small_side(counts, counts.count())
    size = F.size("ids")
    phrases = counts.where(size > 1)
    longer = phrases.where(size > 2).select("lang", "f", "ids", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    longer = longer.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("k") + 1), lambda i: F.slice("ids", i, F.col("k")))).alias("ids"))
    longer = longer.groupBy("lang", "ids").agg(F.max("f").alias("longer"))
    whole = F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * share)
    kept = phrases.withColumnRenamed("f", "a").join(longer, ["lang", "ids"], "left").where(whole).drop("longer")

    part = lambda ids, f: counts.select("lang", F.col("ids").alias(ids), F.col("f").alias(f))
    cuts = kept.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, size)})
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("cast((cast(a as decimal(30,0)) * 2000000) div (cast(l as decimal(30,0)) + r) as long)")
    scored = cuts.groupBy("lang", "ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    chosen = checkpoint(scored.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top).drop("rank"))

    letters = chosen.select("lang", "ids", F.posexplode("ids").alias("at", "id"))
    letters = words.select("lang", "id", "word").join(small_side(letters, letters.count()), ["lang", "id"])
    spelt = letters.groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = chosen.join(spelt, ["lang", "ids"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = 30, share: int = 80, top: int = 2_000) -> str:
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, {LONGEST + 1})) AS k FROM lists WHERE len(w) > 0),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM placed WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= {least}),
parts AS (SELECT lang, k, w, a, unnest(range(2, k)) AS m FROM candidates WHERE k > 2),
inner_phrases AS (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM parts),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer l USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < {share} * a::HUGEINT),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM kept),
scored AS (
  SELECT x.lang, x.phrase, x.a, min({{'score': ((2000000 * x.a::HUGEINT) // (h.f::HUGEINT + t.f))::BIGINT, 'c': c, 'l': h.f, 'r': t.f}}) AS cut
  FROM cuts x JOIN f h ON h.lang = x.lang AND h.phrase = array_to_string(w[1:c], ' ') JOIN f t ON t.lang = x.lang AND t.phrase = array_to_string(w[c + 1:], ' ') GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank, phrase, a, cut.l AS l, cut.r AS r, n, cut.score AS score
FROM scored JOIN totals USING (lang) QUALIFY rank <= {top}
"""
