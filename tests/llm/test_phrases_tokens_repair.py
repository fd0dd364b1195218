"""Operators 11 to 13 against brute force and the library, on small inputs with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import catalog, collocations, conversation_repair, token_counts

CLASHING = ("token", "n", "pieces", "row", "n_bytes", "ids", "f", "spot", "shard", "filter", "word", "phrase", "rank", "conv", "pos", "code", "start", "audit", "state", "key", "tie", "fault", "copy")


def with_clashes(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))


# phrases


def brute_phrases(rows, least, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= share * a for q, b in candidates.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["A", "b", "É", "dd", "the", "x-1", "日本", "q"]
    rows = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", " , "]) for _ in range(rng.randrange(40)))) for _ in range(120)]
    return rows + [("en", None), ("en", ""), (None, "   "), ("en", "a b c d. " * 50), ("en", "z" * 5000 + " z")] + rows[:20]


@pytest.mark.parametrize("several_shards", [False, True])
def test_phrases_against_brute_force(spark, monkeypatch, several_shards):
    if several_shards:
        monkeypatch.setattr(collocations, "SHARD_WORDS", 100)
        monkeypatch.setattr(collocations, "HELD", 50)
        monkeypatch.setattr(collocations, "HELD_WORDS", 3)
    rows = phrase_rows(5)
    df = with_clashes(spark.createDataFrame(rows, "lang string, text string").repartition(6))
    got = collocations.collocations(df, least=6, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = got.collect()
    assert len(got) == len({tuple(r) for r in got}) > 50
    assert {tuple(r) for r in got} == brute_phrases(rows, 6, top=40)
    assert collocations.collocations(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(0, 5), st.lists(st.tuples(st.lists(st.integers(0, 2**64 - 1), min_size=4, max_size=4), st.integers(1, 2**40)), max_size=80))
def test_filters_lose_nothing(width, shard_bits, found):
    want = Counter()
    for ids, n in found:
        want[tuple(ids[:width])] += n
    lanes = collocations.permuted([np.array([ids[j] for ids, _ in found], np.uint64) for j in range(width)])
    lanes, counts = collocations.summed(lanes, np.array([n for _, n in found], np.int64))
    got = Counter()
    for shard in range(1 << shard_bits):
        own = np.flatnonzero(lanes[0] >> np.uint64(64 - shard_bits) == shard) if shard_bits else np.arange(len(counts))
        data = collocations.to_bytes([x[own] for x in lanes], counts[own], shard_bits)
        back, sums = collocations.from_bytes(data, width, shard, shard_bits)
        got.update(dict(zip(zip(*(x.tolist() for x in collocations.unpermuted(back)), strict=True), sums.tolist(), strict=True)))
    assert got == want


def test_equal_first_lanes_stay_apart():
    same = np.zeros(4, np.uint64)
    lanes, counts = collocations.summed([same, np.array([2, 1, 2, 1], np.uint64)], np.array([1, 10, 100, 1000]))
    assert lanes[1].tolist() == [1, 2] and counts.tolist() == [1010, 101]


def test_colliding_ids_are_dealt_anew(monkeypatch):
    plain = collocations.word_hashes

    def colliding(units, seed=2024, **other):
        starts, ids, marked = plain(units, seed=seed, **other)
        return starts, ids if seed > 2024 else ids % np.uint64(7), marked

    monkeypatch.setattr(collocations, "word_hashes", colliding)
    found = next(collocations._words(2024)(iter([collocations.pd.DataFrame({"lang": ["en"], "text": ["a b c d e f g h i"]})])))
    assert found["id"].nunique() < 9
    found = next(collocations._words(2025)(iter([collocations.pd.DataFrame({"lang": ["en"], "text": ["a b c d e f g h i"]})])))
    assert found["id"].nunique() == 9


# token counts


@pytest.mark.parametrize("limit", [400_000, 5])
def test_token_counts_equal_the_library(spark, monkeypatch, limit):
    """With a small limit most pre-tokens meet their counts in a shuffle."""
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", limit)
    path = catalog.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    odd = ["", None, " ", "   ", "\n", "▁", "a▁ b", "<s></s><unk><0x0A>", "x\x00y", "日本語 🤖", "word " * 5000, "z" * 30_000, "  lead and trail  ", "the the the"]
    odd += ["".join(rng.choice(" ▁ab\n\t.e<s>/é漢\x00😀") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(odd)] + [(3, odd[10])] * 3
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = token_counts.token_counts(df, path, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for d, t in rows)
    assert Counter(map(tuple, got.collect())) == want
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def test_token_counts_of_all_documents(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=catalog.vocabulary("piece_bpe_32k.model"))
    want = {r.doc_id: len(library.encode(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in catalog.QUERIES["op12_token_counts"](spark, sf_dir).collect()} == want


# conversations


def brute_repair(rows):
    """rows (conv_id, turn, role, text); a search over (row, state) from the end, with whole strings."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for conv, original in by.items():
        turns = []
        for t, role, text in original:
            k = f"{' ' if conv is None else conv}:{' ' if t is None else t}"
            fault = zlib.crc32(k.encode()) % 20
            if fault:
                role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
                turns += [(t, role, text)] * (2 if fault == 3 else 1)
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            stripped = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else "")
            seen.add((role, text))
        after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        names = {"u": "user", "a": "assistant"}
        best = {s: (0, "", ()) if s in ("", "a") else None for s in ("", "s", "u", "a")}

        def inserting(best, after=after, names=names):
            for _ in range(4):
                for s in best:
                    for i in "ua":
                        to = after.get((s, i))
                        if to and best[to]:
                            c, audit, kept = best[to]
                            best[s] = min(filter(None, [best[s], (c + 5, "I" + audit, (f"{names[i]}:", *kept))]))
            return best

        best = inserting(best)
        for (_, role, text), fault in zip(turns[::-1], faults[::-1], strict=True):
            new = {}
            for s in best:
                c, audit, kept = best[s]
                options = [(c + 2, "D" + audit, kept)]
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    to = s if role == "" else after.get((s, role[0]))
                    if to is not None:
                        c, audit, kept = best[to]
                        options.append((c + more, "K" + audit, (f"{role}:{text}", *kept)))
                    for i in "ua":
                        if (s, i) in after:
                            c, audit, kept = best[after[s, i]]
                            options.append((c + 1 + more, "R" + audit, (f"{names[i]}:{text}", *kept)))
                new[s] = min(options)
            best = inserting(new)
        cost, audit, kept = best[""]
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def conversation_rows(seed):
    rng = random.Random(seed)
    texts = ["Hello.", "Hello.", "What?", "no end", "", None, " \n", "é!", "a. b", "tail. \t\n", " "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown", "s"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randrange(1, 9))]
    rows += [(1000, rng.randrange(900), rng.choice(roles[:5]), rng.choice([*texts, f"t{i}."])) for i in range(700)]  # one conversation holds most rows
    rows += [(1001, None, "user", "same text.")] * 60 + [(1002, -(2**62), "user", "a."), (1002, 2**62, "assistant", "b.")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_brute_force(spark, seed):
    rows = conversation_rows(seed)
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
    got = conversation_repair.repaired(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got, want = got.collect(), brute_repair(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    assert conversation_repair.repaired(df.limit(0)).count() == 0


def test_repair_of_a_dropped_conversation(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in conversation_repair.repaired(df).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(sorted(conversation_repair.MOVES)), max_size=12), st.integers(1, 5))
def test_blocks_give_the_costs_of_the_whole(codes, width):
    """Chained tables of blocks equal the costs row by row, and walks spend what their entry costs."""
    costs = conversation_repair.END
    for code in reversed(codes):
        costs = conversation_repair.before(code, costs)
    chained = conversation_repair.END
    for at in reversed(range(0, len(codes), width)):
        part, behind = bytes(codes[at : at + width]), chained
        chained = conversation_repair.through(conversation_repair.table_of(part), behind)
        for state, (_, spent, left) in enumerate(conversation_repair.walk(part, behind)):
            assert spent + behind[left] == chained[state]
    assert chained == costs
