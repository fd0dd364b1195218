"""Personal data by weak supervision.

Labelers of three kinds (regular expressions, gazetteers, context) vote for or against every candidate span, or abstain.
Expectation maximisation over the counts of vote patterns estimates each labeler's reliability without any label, and a
logistic span classifier is trained on the resulting probabilities, from the votes and from the span's own shape (length,
distinct digits, separators, letters). Spans of the fixed patterns are always reported; candidates of the wider patterns
(obfuscated addresses, telephone numbers without a country code, bank accounts) are added if the classifier accepts them.

Candidates are found in one pass over the texts and written to the checkpoint folder; the training needs only the counts of
their votes and shapes, whose number is bounded by the labelers (3 votes each) and the shapes' few steps.

Nulls and edge cases: a null text counts as empty and has no span; texts are searched whole and in linear time; rows are
independent, so ties, repeated rows and a null ``doc_id`` need no care; an empty table trains nothing and returns no row.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import apart, checkpoint, text_batches

KINDS = ("email", "ip", "card", "phone", "iban")
#: The kinds that have a fixed pattern stand first.
FIXED = 4
#: Fixed patterns. The local part of an address is the run of its letters before the sign, so only the rest is searched.
EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider patterns, whose matches are candidates only.
MASKED_REST = re.compile(r"\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]+)+", re.I)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
#: Gazetteers.
DOMAIN_ENDS = frozenset("com org net edu gov mil int info biz io co de fr es it nl uk us ca eu ch at be pl pt se no fi dk jp cn in br au".split())
CARD_STARTS = frozenset("3456")
IBAN_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
CONTEXT = {
    "email": re.compile(r"mail|contact|write|reply|from|to:", re.I),
    "ip": re.compile(r"\bip\b|addr|host|server|client|login", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|payment|iban", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobile|contact|dial", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta|transfer", re.I),
}
AGAINST = re.compile(r"version|release|\bv\.?$|isbn|order|invoice|\bid\b|serial|page", re.I)
LABELERS = ("pattern", "form", "gazetteer", "before", "against", "company")
WINDOW = 32


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _addresses(text: str, rest: re.Pattern) -> list[tuple[int, int, int]]:
    """Spans of kind email: matches of ``rest`` and the letters of a local part before them."""
    out, lowest = [], 0
    for m in rest.finditer(text):
        start = m.start()
        while start > lowest and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            lowest = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns; matches that fail their test are dropped, not retried."""
    out = _addresses(text, EMAIL_REST) if "@" in text else []
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def wider_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that no fixed pattern covers."""
    found = _addresses(text, MASKED_REST) if "[" in text or "(" in text else []
    found += [(3, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    found += [(4, m.start(), m.end()) for m in IBAN.finditer(text) if _valid_iban(m[0])]
    return apart(found, base, start=1, end=2)


def _valid_iban(string: str) -> bool:
    letters = string.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97 == 1


def shape(string: str) -> str:
    """A span's own features: steps of its length, distinct digits and separators, and whether it holds letters."""
    separators = sum(not c.isalnum() for c in string)
    return f"{min(len(string).bit_length(), 7)}{len(set(string) & DIGITS) // 2}{min(separators, 5)}{int(any(c.isalpha() for c in string))}"


DIGITS = frozenset("0123456789")


def votes(text: str, span: tuple[int, int, int], is_base: bool, company: bool) -> list[int]:
    """1 for, -1 against, 0 abstains, in the order of ``LABELERS``."""
    kind, start, end = span
    string, before = text[start:end], text[max(0, start - WINDOW) : start]
    digits = [c for c in string if c in "0123456789"]
    if kind == 0:
        form = 1 if 6 <= len(string) <= 80 else -1
        gazetteer = 1 if re.split(r"[^a-z0-9]+", string.lower().rstrip("])"))[-1] in DOMAIN_ENDS else -1
    elif kind == 1:
        parts = string.split(".")
        form = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        gazetteer = -1 if parts[0].lstrip("0") == "" else 1 if int(parts[0][-3:]) < 224 else -1
    elif kind == 2:
        form = 1 if len(set(digits)) > 3 else -1
        gazetteer = 1 if digits[0] in CARD_STARTS else -1
    elif kind == 4:
        form = 1 if len(set(digits)) > 3 else -1
        gazetteer = 1 if string[:2] in IBAN_COUNTRIES else -1
    else:
        form = 1 if len(set(digits)) > 3 else -1
        gazetteer = 1 if len(digits) >= 10 and digits[-10] not in "01" or string[0] == "+" else -1
    return [1 if is_base else 0, form, gazetteer, int(bool(CONTEXT[KINDS[kind]].search(before))), -int(bool(AGAINST.search(before))), int(company)]


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for text in batch["text"].fillna(""):
            base = base_spans(text)
            every = [(s, True) for s in base] + [(s, False) for s in wider_spans(text, base)]
            starts = sorted(s[1] for s, _ in every)
            near = [any(o != s[1] and abs(o - s[1]) < 4 * WINDOW for o in starts[max(0, i - 1) : i + 2]) for s, _ in every for i in [bisect_left(starts, s[1])]]
            found.append([{"kind": s[0], "start": s[1], "end": s[2], "base": b, "votes": "".join("-0+"[v + 1] for v in votes(text, s, b, c)), "shape": shape(text[s[1] : s[2]])} for (s, b), c in zip(every, near, strict=True)])
        yield pd.DataFrame({"doc_id": batch["doc_id"], "found": found})


CANDIDATES = "doc_id long, found array<struct<kind:int,start:int,end:int,base:boolean,votes:string,shape:string>>"


def reliabilities(patterns: pd.DataFrame, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes over vote patterns (columns votes, n): (posterior of each pattern, accuracy of each labeler).

    A labeler that votes is right with its own probability, the same for both classes; the prior is estimated too.
    """
    v = np.array([["-0+".index(c) - 1 for c in p] for p in patterns["votes"]], float).reshape(len(patterns), -1)
    n = patterns["n"].to_numpy(float)
    right, prior = np.full(v.shape[1], 0.75), 0.6
    posterior = np.full(len(v), prior)
    for _ in range(rounds):
        logit = np.log(prior / (1 - prior)) + v @ np.log(right / (1 - right))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        voted = np.abs(v) * n[:, None]
        agreed = (np.where(v > 0, posterior[:, None], 0) + np.where(v < 0, 1 - posterior[:, None], 0)) * n[:, None]
        # two votes of either outcome are assumed beforehand, and a labeler is taken to be better than chance
        right = np.clip((agreed.sum(0) + 3) / (voted.sum(0) + 4), 0.55, 0.98)
        prior = float(np.clip((posterior @ n + 1) / (n.sum() + 2), 0.05, 0.95))
    return posterior, right


def features(kind: int, votes: str, shape: str) -> np.ndarray:
    """Input of the span classifier."""
    steps = np.zeros(4 * 10)
    steps[[10 * i + int(c) for i, c in enumerate(shape)]] = 1
    return np.concatenate([["-0+".index(c) - 1 for c in votes], np.eye(len(KINDS))[kind], steps, [1.0]])


def classifier(patterns: pd.DataFrame, steps: int = 400) -> np.ndarray | None:
    """Weights of a logistic span classifier trained on the posteriors of patterns (kind, votes, shape, n)."""
    if patterns.empty:
        return None
    posterior, _ = reliabilities(patterns)
    x = np.stack([features(*row) for row in zip(patterns["kind"], patterns["votes"], patterns["shape"], strict=True)])
    weight = patterns["n"].to_numpy(float) ** 0.5
    weight /= weight.sum()
    theta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ theta))
        theta -= 2.0 * (x.T @ (weight * (p - posterior)) + 1e-3 * theta)
    return theta


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the fixed patterns, base_sha256, spans and n_added."""
    text_batches(docs.sparkSession)
    found = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_candidates, CANDIDATES))
    patterns = found.select(F.explode("found").alias("f")).groupBy("f.kind", "f.votes", "f.shape").agg(F.count("*").alias("n"))
    theta = classifier(patterns.orderBy("kind", "votes", "shape").toPandas())  # as many rows as there are votes and shapes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        accepted = cache(lambda *span: 1 / (1 + np.exp(-features(*span) @ theta)) >= threshold)
        joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            rows = []
            for every in batch["found"]:
                base = sorted((f["kind"], f["start"], f["end"]) for f in every if f["base"])
                added = [(f["kind"], f["start"], f["end"]) for f in every if not f["base"] and accepted(f["kind"], f["votes"], f["shape"])]
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in range(FIXED)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return found.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
