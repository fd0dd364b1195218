"""Token counts of whole texts under a piece vocabulary, from the pieces of distinct pre-tokens.

No piece of such a vocabulary has a blank behind another letter, so merges never cross the start of a run of blanks, and a
text's count is the sum over its pre-tokens: a run of blanks and the letters up to the next one, a blank put before the
text. So the pieces of each distinct pre-token are counted once; per document only the frequencies of its pre-tokens are
made, joined to the counts and summed. Ids exist for one distinct pre-token at a time and are never kept.

Scale. Pre-tokens are pre-aggregated in the workers before they are shuffled. The counts of the most frequent ones, as many
as ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` hold, are broadcast; only occurrences of rarer ones meet their counts in
a shuffle, so a word that stands in all documents never is a hot key. The sum of a document leaves its task as one row.

Nulls and edge cases: a null text counts as empty: no bytes, no tokens; a text of blanks has the tokens of its one
pre-token; rows are independent, so ties, repeated rows and a null ``doc_id`` give one result row each; memory is bounded
by one text and ``HELD`` distinct pre-tokens a worker. Other columns are not read. The input must be the same whenever it
is read, as tables are: rows are told apart by their place in it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_ROWS, text_batches, written

#: How the vocabulary writes a blank.
BLANK = "▁"
PRETOKEN = re.compile(" +[^ ]*")
#: Bytes of pre-tokens up to which their counts are broadcast.
BROADCAST_BYTES = 16_000_000
#: Distinct pre-tokens that a worker sums up before it sends them on.
HELD = 200_000
#: Rows of a document's frequencies that leave a worker at a time.
SENT = 100_000


def pre_tokens(text: str | None) -> list[str]:
    """The pre-tokens of a text, each with its leading blanks."""
    return PRETOKEN.findall(" " + text.replace(BLANK, " ")) if text else []


@cache
def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        raise ValueError(f"{path}: a piece goes on behind a blank, so texts can't be counted by pre-tokens")
    return model


def piece_counts(model, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. The library puts a blank before what it is given, so one is taken off here; a single blank is
    what two have more than none."""
    alone = 1 if model.piece_to_id(BLANK) != model.unk_id() else len(BLANK.encode())
    return [len(ids) if len(token) > 1 else alone for token, ids in zip(tokens, model.encode([t[1:] for t in tokens], num_threads=1), strict=True)]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) over the texts of a task."""
    held: Counter[str] = Counter()

    def send() -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_pydict({"token": list(held), "n": pa.array(held.values(), pa.int64())})
            held.clear()

    for batch in batches:
        for text in batch["text"]:
            held.update(pre_tokens(text.as_py()))
            if len(held) > HELD:
                yield from send()
    yield from send()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n_bytes, token, n) of every document; one without pre-tokens has a row with a null token."""
    for batch in batches:
        tokens, counts, places = [], [], []

        def send(batch=batch) -> pa.RecordBatch:
            at = pa.array(places, pa.int32())
            kept = [batch[c].take(at) for c in ("row", "doc_id", "n_bytes")]
            return pa.RecordBatch.from_arrays([*kept, pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["row", "doc_id", "n_bytes", "token", "n"])

        for i, text in enumerate(batch["text"]):
            found = Counter(pre_tokens(text.as_py())) or {None: 0}
            tokens += found
            counts += found.values()
            places += [i] * len(found)
            if len(tokens) > SENT:
                yield send()
                tokens, counts, places = [], [], []
        if tokens:
            yield send()


def _common(counted: DataFrame) -> int:
    """The least b such that pre-tokens seen ``2**b`` times or more may be broadcast together."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r.b: (r.rows, r.bytes) for r in counted.groupBy(level.alias("b")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("token")).alias("bytes")).collect()}  # 64 rows at most
    rows = size = 0
    least = 64
    for b in sorted(sizes, reverse=True):
        rows, size = rows + sizes[b][0], size + sizes[b][1]
        if rows > BROADCAST_ROWS or size > BROADCAST_BYTES:
            break
        least = b
    return least


def token_counts(docs: DataFrame, model: str, limit: int = 4_096) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``model`` is the path of a sentencepiece model that begins texts with a blank and normalises nothing else.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = piece_counts(load(model), batch["token"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["token"], batch["n"], pa.array(found, pa.int64())], ["token", "n", "pieces"])

    text_batches(docs.sparkSession)
    vocabulary = docs.select("text").mapInArrow(_vocabulary, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = written(vocabulary.mapInArrow(pieces, "token string, n long, pieces long"))
    least = _common(counted)
    level = F.floor(F.log2("n")) >= least
    common, rare = counted.where(level).select("token", "pieces"), counted.where(~level).select("token", "pieces")

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    frequencies = rows.mapInArrow(_frequencies, "row long, doc_id long, n_bytes long, token string, n long")
    pieces_of = lambda found: found.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_bytes")), F.sum("n_tokens").alias("n_tokens"))
    known = F.coalesce(F.col("n") * F.col("pieces"), F.lit(0))
    total = pieces_of(frequencies.join(F.broadcast(common), "token", "left").select("row", "doc_id", "n_bytes", known.alias("n_tokens")))
    if not rare.isEmpty():
        others = frequencies.select("row", "token", "n").where("token is not null").join(F.broadcast(common.select("token")), "token", "left_anti").join(rare, "token")
        absent = F.lit(None).cast("long")
        others = others.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_tokens")).select("row", absent.alias("doc_id"), absent.alias("n_bytes"), "n_tokens")
        total = pieces_of(total.unionByName(others))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
