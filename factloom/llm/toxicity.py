"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is logistic in the summed weights of its distinct words; a word's weight sums those of the word
itself and of its character 4- and 5-grams. A document's probability is the noisy-or of its sentences and one background
term, trained by gradient descent from document labels alone. The trained sentence scores then locate the offending
sentences.

The classifier is fitted on at most ``TRAIN_DOCS`` labelled documents (those with the smallest hashes, never a held-out
one, and none of more than ``TRAIN_CHARS``), one text each; every document is scored. In training as in scoring a sentence
counts only if its weights sum to more than nothing. Labels, language, source and doc_id are no inputs of a score.

Nulls and edge cases: a null or empty text has the background score; labels that are null are left out, repeated labels of
a document count as toxic if one does; without any toxic label all scores are low; a null ``doc_id`` is scored and not held
out. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import text_batches

TRAIN_DOCS = 8_000
TRAIN_CHARS = 200_000
FEATURES = 3_000
CACHED_WORDS = 100_000
STEPS = 300
FOLDS = 5
#: Names of the two biases among a model's weights.
BIAS, BACKGROUND = "(bias)", "(background)"
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def features_of(word: str) -> set[str]:
    """The word in angle brackets and its character 4- and 5-grams."""
    return {f"<{word}>"} | {word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1)}


class SentenceModel:
    """Weights of features, biases of a sentence with features and of the background."""

    def __init__(self, weights: dict[str, float], bias: float, background: float):
        self.weights, self.bias, self.background = weights, bias, background
        self.by_word: dict[str, float] = {}

    @classmethod
    def from_rows(cls, rows: list[tuple[str, float]]) -> SentenceModel:
        weights = dict(map(tuple, rows))
        return cls(weights, weights.pop(BIAS, -3.0), weights.pop(BACKGROUND, -4.0))

    def word(self, word: str) -> float:
        known = self.by_word.get(word)
        if known is None:
            if len(self.by_word) > CACHED_WORDS:
                self.by_word.clear()
            known = self.by_word[word] = sum(self.weights.get(f, 0.0) for f in sorted(features_of(word)))
        return known

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and (start, end, probability) of the sentences that have learned features."""
        clean, found = 1 - _logistic(self.background), []
        if text and any(map(self.word, set(WORD.findall(text.lower())))):
            for m in SENTENCE.finditer(text):
                logit = sum(map(self.word, sorted(set(WORD.findall(m[0].lower())))))
                if logit:
                    p = _logistic(self.bias + logit)
                    clean *= 1 - p
                    found.append((m.start(), m.end(), p))
        return 1 - clean, found


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Kept(dict):
    """Features of a word that are among given ones, in order; emptied when it has grown."""

    def __init__(self, among: dict):
        self.among = among

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[word] = tuple(f for f in sorted(features_of(word)) if f in self.among)
        return found


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(texts: list[str], toxic: list[int]) -> SentenceModel:
    """Select features by document counts, then train the noisy-or."""
    n_toxic = sum(map(bool, toxic))
    n_clean = len(toxic) - n_toxic
    counts = Counter()
    for text, y in zip(texts, toxic, strict=True):
        if y:
            counts.update(set().union(*map(features_of, set(WORD.findall(text.lower())))))
    in_toxic = {f: n for f, n in counts.items() if n >= 3}
    del counts
    known = _Kept(in_toxic)
    in_clean = Counter()
    for text, y in zip(texts, toxic, strict=True):
        if not y:
            in_clean.update(set().union(*map(known.__getitem__, set(WORD.findall(text.lower())))))
    gain = {f: np.log((n + 0.5) / (n_toxic + 1)) - np.log((in_clean[f] + 0.5) / (n_clean + 1)) for f, n in in_toxic.items()}
    worth = {f: (in_toxic[f] / n_toxic - in_clean[f] / max(n_clean, 1)) * g for f, g in gain.items() if g > 1}
    chosen = sorted(worth, key=lambda f: (-worth[f], f))[:FEATURES]
    index = {f: i for i, f in enumerate(chosen)}

    hot = _Kept(index)
    doc, sentence, feature, n_sentences = [], [], [], 0
    for d, text in enumerate(texts):
        if not any(map(hot.__getitem__, set(WORD.findall(text.lower())))):
            continue
        for m in SENTENCE.finditer(text):
            got = [index[f] for w in sorted(set(WORD.findall(m[0].lower()))) for f in hot[w]]
            if got:
                doc.append(d)
                sentence += [n_sentences] * len(got)
                feature += got
                n_sentences += 1
    weights, bias, background = _train(np.array(toxic, float), np.array(doc, int), np.array(sentence, int), np.array(feature, int), len(chosen))
    return SentenceModel({f: float(weights[i]) for f, i in index.items() if weights[i] > 0}, bias, background)


def _train(y, doc, sentence, feature, n_features) -> tuple[np.ndarray, float, float]:
    """Adam on the noisy-or likelihood; weights stay non-negative, as features are signs of toxicity only."""
    theta = np.concatenate([np.full(n_features, 0.5), [-3.0, -4.0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        sums = np.bincount(sentence, theta[feature], len(doc)) if len(doc) else np.empty(0)
        p, p0 = _logistic(sums + theta[-2]) * (sums > 0), _logistic(theta[-1])
        clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))) * (1 - p0) if len(doc) else np.full(len(y), 1 - p0)
        pull = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        by_sentence = pull[doc] * p if len(doc) else np.empty(0)
        gradient = np.concatenate([np.bincount(feature, by_sentence[sentence], n_features), [by_sentence.sum(), (pull * p0).sum()]]) / max(len(y), 1)
        gradient[:-2] += 1e-4 * theta[:-2]
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta -= 0.08 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta[:-2] = np.where(theta[:-2] > 1e-3, theta[:-2], 0)
        theta[-1] = min(theta[-1], -2.0)
    return theta[:-2], float(theta[-2]), float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> SentenceModel:
    """Fit on at most ``limit`` labelled documents outside the held-out fold."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS)
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most ``limit`` rows
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", F.lit(0).alias("one"))
    # one task fits the model: its rows are at most ``limit``, and it returns at most ``FEATURES`` weights
    return SentenceModel.from_rows(rows.groupBy("one").applyInPandas(_fit_rows, "feature string, weight double").collect())


def _fit_rows(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "text"])
    model = fit(rows["text"].tolist(), (rows["toxic"] > 0).astype(int).tolist())
    named = [*model.weights.items(), (BIAS, model.bias), (BACKGROUND, model.background)]
    return pd.DataFrame(named, columns=["feature", "weight"])


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted and the offending sentences (start, end, score)."""
    model = train(docs, labels, limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scored = [model.score(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "held_out": batch["held_out"],
                "score": [float(s) for s, _ in scored],
                "predicted": [int(s >= 0.5) for s, _ in scored],
                "offending": [[{"start": a, "end": b, "score": float(p)} for a, b, p in found if p >= 0.5] for _, found in scored],
            })

    text_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    return source.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def filtered(docs: DataFrame, model: SentenceModel, threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the documents whose score reaches ``threshold``."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([float(model.score(t)[0]) for t in texts])

    text_batches(docs.sparkSession)
    return docs.where(score(F.col("text")) < threshold)
