"""Byte-level BPE encoding and decoding by a prefix-sharing trie.

The encoding of a word is fixed by its last token and the encoding of what stands before it: token ``t`` ends the prefix
``w[:j]`` exactly if the last token of ``w[:j - len(t)]`` and ``t`` do not merge with each other. So a node of a trie needs
one state, its last token, and words that share a prefix share the states along it. The distinct words of a batch are
walked in byte order, which is the trie's depth-first order: the stack of states down to the common prefix with the
word before is kept, and only the rest is computed.

The vocabulary file is a parameter. Its kind must be that of GPT-2: no normaliser, byte-level pre-tokens, merges by rank.
Results equal those of the ``tokenizers`` library, added tokens in a text included.

Nulls and edge cases: a null text counts as empty; an empty text has no tokens and decodes to an empty text; memory is
bounded by the words of one batch and a word cache of fixed size; rows are independent, so ties, repeated rows and a null
``doc_id`` need no care. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import text_batches

#: The split into pre-tokens that the byte-level scheme fixes.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_WORDS = 300_000
CACHED_PAIRS = 250_000


def _byte_letters() -> dict[str, int]:
    """The byte for each letter in which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the
    other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder for one vocabulary file; made once in a worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        unwritten = lambda piece: bytes(letters[c] for c in piece)
        self.pieces = {i: unwritten(p) for p, i in spec["model"]["vocab"].items()}
        self.ids = {p: i for i, p in self.pieces.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(unwritten(a), unwritten(b)): r for r, (a, b) in enumerate(pairs)}
        # lengths of the tokens that end with given three bytes, longest first; then 2 and 1
        lengths: dict[bytes, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {tail: (*sorted(found, reverse=True), 2, 1) for tail, found in lengths.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: t.encode() for t, i in self.added.items()}
        self.written = {str(i): p for i, p in self.pieces.items()}
        self.pretoken = regex.compile(PRETOKEN)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, str] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE: merge the adjacent pair of least rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves these two tokens side by side."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > CACHED_PAIRS:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def traverse(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) of distinct words, depth first over their trie."""
        ids, lengths, fits, fit, short = self.ids, self.lengths, self.fits, self.fit, (2, 1)
        last: list[bytes] = [b""]  # last[j]: last token of the current path's first j bytes
        before = b""
        for word in sorted(words):
            common, most = 0, min(len(word), len(before))
            while common < most and word[common] == before[common]:
                common += 1
            del last[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                for length in lengths.get(word[end - 3 : end], short) if end > 2 else short:
                    start = end - length
                    if start < 0:
                        continue
                    token = word[start:end]
                    if token not in ids:
                        continue
                    if start:
                        left = last[start]
                        fitting = fits.get((left, token))
                        if fitting is None:
                            fitting = fit(left, token)
                        if not fitting:
                            continue
                    last.append(token)
                    break
            out, end = [], len(word)
            while end:
                out.append(ids[last[end]])
                end -= len(last[end])
            before = word
            yield word, out[::-1]

    def learn(self, words: set[str]) -> None:
        """Cache the joined ids of words that are not cached yet."""
        new = {w.encode("utf-8", "replace"): w for w in words if w not in self.words}
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
            new = {w.encode("utf-8", "replace"): w for w in words}
        for data, found in self.traverse(list(new)):
            self.words[new[data]] = ",".join(map(str, found))

    def split(self, text: str) -> list[tuple[bool, str]]:
        """(is an added token, piece) in order."""
        parts = self.split_added.split(text) if self.split_added else [text]
        return [(i % 2 == 1, p) for i, p in enumerate(parts) if p]

    def encode_all(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """(number of ids, ids joined by commas) of each text."""
        cut = [[(special, [p] if special else self.pretoken.findall(p)) for special, p in self.split(t)] for t in texts]
        start, held = 0, set()
        for i, parts in enumerate(cut):
            for special, tokens in parts:
                if not special:
                    held.update(tokens)
            if len(held) > CACHED_WORDS // 2 or i == len(cut) - 1:
                self.learn(held)
                for done in cut[start : i + 1]:
                    ids = ",".join([str(self.added[p[0]]) if special else ",".join(map(self.words.__getitem__, p)) for special, p in done])
                    yield ids.count(",") + 1 if ids else 0, ids
                start, held = i + 1, set()

    def decode(self, ids: str) -> str:
        """Text of comma-joined ids, added tokens kept; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.written.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@cache
def load(path: str) -> TrieBpe:
    return TrieBpe(path)


def _slices(frame: pd.DataFrame, chars: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """Runs of rows of about ``chars`` characters, so that a batch of long texts stays small in memory."""
    sizes = frame["text"].str.len().fillna(0).cumsum() // chars
    for _, part in frame.groupby(sizes.to_numpy(), sort=False):
        yield part


def bpe_round_trip(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, ids_sha256 and decoded_sha256; with ``keep_ids`` also ids and decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = load(vocabulary)
        for batch in batches:
            for part in _slices(batch.assign(text=batch["text"].fillna(""))):
                encoded = list(coder.encode_all(part["text"].tolist()))
                decoded = [coder.decode(ids) for _, ids in encoded]
                out = pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(),
                    "n_tokens": [n for n, _ in encoded],
                    "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for _, ids in encoded],
                    "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in decoded],
                })
                if keep_ids:
                    out["ids"] = [[int(i) for i in ids.split(",")] if ids else [] for _, ids in encoded]
                    out["decoded"] = decoded
                yield out

    text_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)
