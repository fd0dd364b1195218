"""Secret scan: fixed patterns plus a token-efficiency test.

Natural words and identifiers compress well under a byte-level BPE vocabulary, random strings do not: a candidate string
whose characters per token fall below ``MAX_CHARS_PER_TOKEN`` is reported as kind ``random``. Known digests (hex of a digest's
length, UUIDs) and plain numbers and dates are excluded before the test; the fixed patterns still report what they match.
Words in any case, with or without separators, are left to the test: of random strings of 16 to 40 letters, digits or
base-64 signs at least 95 in 100 fall below the ratio (of lower-case letters alone 3 in 4), of 1,100 invented words of
16 letters and more 3 do. The fewer the tokens, the more the ratio varies, so strings of ``SHORT`` to ``LONG - 1``
characters have the lower bound ``SHORT_CHARS_PER_TOKEN``, and those with separators are left out, as codes and paths of
that length are cut as finely: of random letters and digits at least 95 in 100 fall below it, of letters in both cases 87,
of lower-case letters and digits 77, of lower-case letters alone 36; of 26,000 invented words 6 do.

Nulls and edge cases: a null text counts as empty and has no span; very long candidates are measured whole; rows are
independent, so ties, repeated rows and a null ``doc_id`` need no care. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import apart, text_batches

#: Fixed patterns in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
#: Strings that are put to the token-efficiency test.
SHORT, LONG = 12, 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORT},}}={{0,2}}")
SEPARATOR = re.compile(r"[/_-]")
MAX_CHARS_PER_TOKEN = 1.85
SHORT_CHARS_PER_TOKEN = 1.65
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[0-9_/+-]+")
#: Split before the merges of the vocabulary.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("byte-level", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; a match that fails its length is dropped, not retried."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


#: ``HEX`` takes maximal runs, so a run of 24 or more is the same as a match of this that starts at a run's start.
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def known(string: str) -> bool:
    """A digest, a number or a date, by its form."""
    bare = string.rstrip("=")
    return bool(UUID.fullmatch(bare) or NUMBER.fullmatch(bare) or len(bare) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", bare))


def random_spans(text: str, encoding: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """(start, kind, end) of strings with few characters per token."""
    found = []
    for m in CANDIDATE.finditer(text):
        short = len(m[0].rstrip("=")) < LONG
        if known(m[0]) or short and SEPARATOR.search(m[0]):
            continue
        if len(m[0]) < (SHORT_CHARS_PER_TOKEN if short else MAX_CHARS_PER_TOKEN) * len(encoding.encode_ordinary(m[0])):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_assign, n_access, n_hex, n_random, base_sha256, spans and found (the strings)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            rows = []
            for text in batch["text"].fillna(""):
                base = base_spans(text)
                extra = apart(random_spans(text, encoding), base)
                spans = sorted(base + extra)
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), [text[a:b] for a, _, b in spans]))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "found"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, found array<string>"
    )
