"""Queries that SQL can't express, against plain Python over the whole tables of a small scale."""

import hashlib
import re
import unicodedata
from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from factloom import catalog
from factloom.functions.numbers import extract_numbers
from factloom.functions.text import coverage
from factloom.operators import verification
from factloom.operators.verification import BRACKET, NON_CLAIM


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def test_text_normalisation(spark, sf_dir, tables):
    want = Counter()
    for r in tables("conversations"):
        t = " ".join(unicodedata.normalize("NFKC", r.text).casefold().split())
        want[r.conv_id, r.turn, len(t), sha(t)] += 1
    assert Counter(map(tuple, catalog.QUERIES["text_normalisation"](spark, sf_dir).select("conv_id", "turn", "n", "sha").collect())) == want


def pieces(text, most=3000):
    """Paragraphs cut by lines, then sentences, then length, each cut only where the one before has left too much."""
    if len(text) <= most:
        return [text]
    out = []
    lines = [x.strip() for x in text.split("\n") if x.strip()] if "\n" in text.strip() else [text]
    for line in lines:
        for sentence in [line] if len(line) <= most else re.split(r"(?<=[.!?])\s+", line):
            out += [sentence[i : i + most] for i in range(0, len(sentence), most)]
    return out


def chunked(text):
    """Blocks are gathered to 2,000 letters, never beyond 3,000; a chunk begins with the last 200 letters of the one before."""
    assert "<TABLE>" not in text
    blocks = [b for p in re.split(r"\n\s*\n", text) if p.strip() for b in pieces(p.strip()) if b]
    out, now, fresh = [], "", False
    for block in blocks:
        longer = f"{now}\n\n{block}".strip() if now else block
        if len(longer) > 3000:
            if fresh:
                out.append(now)
            now, fresh = block, True
            continue
        now, fresh = longer, True
        if len(now) >= 2000:
            out.append(now)
            now, fresh = now[-200:], False
    return out + [now] * fresh


def test_chunk_documents(spark, sf_dir, tables):
    want = {(r.doc_id, i, len(c), False, sha(c)) for r in tables("documents") for i, c in enumerate(chunked(r.text or ""))}
    got = catalog.QUERIES["chunk_documents"](spark, sf_dir).select("doc_id", "chunk_index", "char_length", "contains_table", "sha").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


SCALE = {"raw": ("scale", 1.0), "thousand": ("scale", 1e3), "million": ("scale", 1e6), "billion": ("scale", 1e9), "percent": ("percent", 1.0)}


def normal(value, unit):
    kind, factor = SCALE[unit]
    return kind, value * factor


def test_coverage_uncovered(spark, sf_dir, tables):
    want = set()
    for r in tables("documents"):
        if not re.search("[0-9]{2}", r.text or ""):
            continue
        plain = re.sub(NON_CLAIM, "", re.sub(BRACKET, "", r.text))
        claim = float(re.search("[0-9]{2,9}", r.text)[0])
        known = [normal(claim, "raw"), normal(42.0, "raw")]
        for n in extract_numbers(plain):
            kind, norm = normal(n["value"], n["unit"])
            signs = (1, -1) if n["paren"] else (1,)
            if not any(k == kind and abs(v - s * norm) <= max(abs(norm) * 0.01, 0.05) for k, v in known for s in signs):
                want.add((r.doc_id, norm))
    got = catalog.QUERIES["coverage_uncovered"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(r.answer_id, r.norm) for r in got} == want != set()


def test_claim_grounding(spark, sf_dir, tables):
    rows = tables("conversations")
    texts = {(r.conv_id, r.turn + 1): r.text for r in rows}
    sizes = Counter(r.conv_id for r in rows)
    want = Counter()
    for r in rows:
        index = r.turn if r.role == "assistant" else r.turn + 1
        quote = r.text.split(".", 1)[0]
        plain = " ".join(unicodedata.normalize("NFKC", quote).casefold().split())
        exact, share, longest = coverage(quote, texts.get((r.conv_id, index)))
        enough = len(plain) >= 15 or len(re.sub("[^0-9]", "", plain)) >= 6
        fits = exact or share >= 0.9 and longest >= min(30, len(plain))
        out = index < 1 or index > sizes[r.conv_id]
        want["citation_out_of_range" if out else "quote_too_short" if not enough else "grounded" if fits else "qualitative_quote_not_found"] += 1
    assert {r.check: r.n for r in catalog.QUERIES["claim_grounding"](spark, sf_dir).collect()} == want


def test_number_extract_on_plain_numbers(spark):
    """Whole texts' runs of digits that stand alone between blanks are all found, with their places and values."""
    sf_dir, got = "/root/testdata/sf0.01", {}
    for r in catalog.QUERIES["number_extract"](spark, sf_dir).collect():
        got.setdefault(r.doc_id, {})[r.start] = (r.end, r.value)
    seen = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for m in re.finditer(r"(?<![^\s])[0-9]{1,15}(?=[\s.]*(\s|$))", r.text or ""):
            if re.match(r"\s*(thousand|million|billion|percent|%|[-–(])", r.text[m.end() :], re.I):
                continue
            assert got[r.doc_id][m.start()] == (m.end(), float(m[0])), (r.doc_id, m)
            seen += 1
    assert seen > 5


def test_html_parse_keeps_all_text(spark, sf_dir, tables):
    """Without tables and footers the letters of a parsed page are those between its tags, scripts and styles left out."""
    import html

    got = {r.page_id: r.n_chars for r in catalog.QUERIES["html_parse"](spark, sf_dir).collect()}
    from factloom.operators.chunking import parse_filing

    same = 0
    for r in tables("pages"):
        if r.html and "<table" not in r.html.lower() and "|" not in r.html:
            bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", r.html)
            bare = html.unescape(re.sub(r"(?s)<!--.*?-->|<[^>]*>", "", bare))
            text = parse_filing(r.html)[0]
            assert len(text) == got[r.page_id]
            same += "".join(text.split()) == "".join(bare.split())
    assert same > 20


def test_quotes_settled_natively_are_those_of_the_automaton(spark):
    """Pairs around the anchor's length, of other alphabets and null, settled as the whole comparison settles them; few reach Python."""
    import random

    from factloom.functions import text

    rng, pairs = random.Random(5), [(None, "a b"), ("a b", None), ("", ""), ("Straße und Weg nach Hause, weit", "STRASSE und Weg nach Hause, weit")]
    for n in range(400):
        source = "".join(rng.choice("ab c,1") for _ in range(rng.randrange(20, 120)))
        start, size = rng.randrange(len(source)), rng.randrange(5, 70)
        quote = list(source[start : start + size])
        for _ in range(n % 5):
            quote.insert(rng.randrange(len(quote) + 1), rng.choice("xyz \té" if n % 7 == 0 else "xyz \n"))
        pairs.append(("".join(quote), source if n % 3 else source.upper()))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, s string")
    got = {r.i: r.m for r in df.withColumn("state", text.quote_state(F.col("q"), F.col("s"))).select("i", text.quote_matches(F.col("q"), F.col("s"), F.col("state")).alias("m")).collect()}
    for i, (q, s) in enumerate(pairs):
        exact, share, longest = text.coverage(q, s)
        form = text.normal_form(q)
        enough = len(form) >= text.QUOTE_CHARS or sum(c in "0123456789" for c in form) >= text.QUOTE_DIGITS
        assert bool(got[i]) == (enough and (exact or (share >= text.COVERAGE and longest >= min(text.ANCHOR, len(form))))), (q, s)


def test_settled_quotes_do_not_reach_python(spark, monkeypatch):
    """A contained quote and one without a common piece come to the comparison as null."""
    from factloom.functions import text
    from factloom.functions.batch import arrow_function

    @arrow_function("boolean")
    def refuse(quotes, sources):
        if quotes.null_count != len(quotes):
            raise AssertionError("compared in Python")
        return quotes.is_null()

    monkeypatch.setattr(text, "_covered", refuse)
    rows = [("a price of $12 in all, said the sheet", "It was invoiced at A price of  $12 in all, said the sheet."), ("Quite another sentence that stands nowhere else", "The line of this order was delivered in full")]
    df = spark.createDataFrame(rows, "q string, s string")
    assert [r.m for r in df.withColumn("state", text.quote_state(F.col("q"), F.col("s"))).select(text.quote_matches(F.col("q"), F.col("s"), F.col("state")).alias("m")).collect()] == [True, False]


def test_plain_texts_have_the_numbers_of_the_full_scan():
    from factloom.functions.numbers import fields_of, scan_numbers

    pieces, random = ["1", "23", "1,234", ",", ".", "a", "_", " ", "$", "(", ")", "-", "%", " million", "percent", "\n", "é", "٣"], Random(5)
    texts = [None, "", *("".join(random.choices(pieces[: random.choice([9, len(pieces)])], k=random.randint(1, 12))) for _ in range(5000))]
    assert fields_of(texts) == [[(n.value, n.unit, n.start, n.end, n.paren) for n in scan_numbers(t or "")] for t in texts]


def test_texts_that_may_hold_non_claims_are_all_looked_at():
    said = ["March 3, 2020", "mAY 4 1999", "2020-01-02", "in 1999.", "10-K", "10-qs", "Note 7", "NOTE\t12", "3 years", "45-day", "$1,234.50 .", "7 in all"]
    missed = [t for t in said if re.search(verification.NON_CLAIM, t) and not re.search(verification.MAYBE_NON_CLAIM, t)]
    assert not missed and not re.search(verification.MAYBE_NON_CLAIM, "A line costs $1,234.50 . A line costs $9.00 .")
