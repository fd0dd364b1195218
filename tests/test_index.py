"""The store, maintained statistics, the vector index, ranks by counting and pattern search, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import bm25, corpus, goldrank, incremental, patterns, vector_index
from factloom.sources.store import ChunkStore, Conflict
from tests.oracle import assert_same

RECIPE = {"v": 1}


def chunks_of(spark, files):
    """(chunks, files) of {relpath: (accession, ticker, [texts])}."""
    rows = [(rel, acc, tick, f"{acc}_{i}", t) for rel, (acc, tick, texts) in files.items() for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "relpath string, accession string, ticker string, doc_id string, text string")
    manifest = corpus.manifest(spark.createDataFrame([(rel, acc, repr(x)) for rel, (acc, _, x) in files.items()], "relpath string, accession string, content string"))
    return incremental.indexed(chunks), manifest


def state(store):
    rows = sorted((r.doc_id, r.text) for r in store.rows().collect())
    terms = {(r.ticker, r.term): r.n for r in store.tables()["terms"].collect()}
    sizes = {r.ticker: (r.n_docs, r.total_length) for r in store.tables()["sizes"].collect()}
    return rows, terms, sizes


def brute(files):
    rows, terms, sizes = [], {}, {}
    for acc, tick, texts in files.values():
        for i, t in enumerate(texts):
            rows.append((f"{acc}_{i}", t))
            words = (t or "").split()
            n, length = sizes.get(tick, (0, 0))
            sizes[tick] = (n + 1, length + len(words))
            for w in set(words):
                terms[tick, w] = terms.get((tick, w), 0) + 1
    return sorted(rows), terms, sizes


def test_updates_equal_a_rebuild(spark, tmp_path):
    """Files come, change, shrink and go at random; rows and statistics are those of a build from nothing each time."""
    rng = random.Random(4)
    store = ChunkStore(spark, str(tmp_path / "store"))
    files = {}
    for step in range(4):
        for i in range(6):
            if rng.random() < 0.6 or not files:
                files[f"f{i}"] = (f"a{i}", rng.choice(["A", "B"]), [" ".join(rng.choices("uvwxyz", k=rng.randrange(0, 5))) for _ in range(rng.randrange(1, 4))])
            elif rng.random() < 0.4:
                files.pop(f"f{i}", None)
        done = store.update(*chunks_of(spark, files), RECIPE, f"sha{step}", incremental.maintained("ticker"))
        assert (done.reason == "no_sidecar") == (step == 0)
        assert state(store) == brute(files)
        assert store.head()["rows"] == len(brute(files)[0]) and store.head()["sha"] == f"sha{step}"
    before = state(store)
    again = store.update(*chunks_of(spark, files), RECIPE, "other", incremental.maintained("ticker"))
    assert (again.added, again.deleted, again.version) == (0, 0, store.head()["version"]) and store.head()["sha"] == "sha3"
    store.compact()
    assert len(store.head()["segments"]) == 1 and state(store) == before


def test_reasons_for_a_rebuild(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    chunks, files = chunks_of(spark, {"f": ("a", "A", ["x y", "z"])})
    assert store.head() is None and store.plan(files, RECIPE)[0] == "no_sidecar"
    store.update(chunks, files, RECIPE, "s")
    assert store.plan(files, RECIPE)[0] is None and store.plan(files, RECIPE, forced=True)[0] == "forced" and store.plan(files, {"v": 2})[0] == "recipe_changed"
    head = store.head()
    store.commit(store.next_version(), {**head, "rows": 7})
    assert store.plan(files, RECIPE)[0] == "row_count"
    store.commit(store.next_version(), {**head, "segments": ["segments/none"]})
    assert store.plan(files, RECIPE)[0] == "collection_missing"
    store.commit(store.next_version(), {"sha": "s"})
    assert store.plan(files, RECIPE)[0] == "bad_manifest"
    store.commit(store.next_version(), ["no object"])
    with pytest.raises(ValueError, match="no corpus sha"):
        store.head()
    assert store.plan(files, RECIPE)[0] == "no_sidecar"
    store.clear()
    assert store.head() is None
    assert store.update(chunks, files, RECIPE, "t").reason == "no_sidecar" and store.rows().count() == 2


def test_a_slower_writer_sees_a_conflict(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    store.commit(1, {"sha": "first"})
    with pytest.raises(Conflict):
        store.commit(1, {"sha": "second"})
    assert store.head()["sha"] == "first" and store.versions() == [1]
    chunks, files = chunks_of(spark, {"f": ("a", "A", ["x"])})
    with pytest.raises(Conflict):  # another writer commits while this update is under way
        store.update(chunks, files, RECIPE, "slow", prepare=lambda rows: (store.commit(2, {"sha": "quick"}), rows)[1])
    assert store.head()["sha"] == "quick"


def test_deletion_goes_by_accession(spark, tmp_path):
    """A file that comes back under its accession with fewer rows leaves none of the old ones."""
    store = ChunkStore(spark, str(tmp_path / "store"))
    store.update(*chunks_of(spark, {"f": ("a", "A", ["one", "two", "three"]), "g": ("b", "A", ["four"])}), RECIPE, "1")
    done = store.update(*chunks_of(spark, {"f": ("a", "A", ["uno"]), "g": ("b", "A", ["four"])}), RECIPE, "2")
    assert (done.added, done.deleted) == (1, 3) and sorted(r.text for r in store.rows().collect()) == ["four", "uno"]
    assert store.rows().where("text = 'four'").first()["_version"] == 1


def test_scores_from_the_index_are_those_of_the_texts(spark):
    docs = spark.createDataFrame([(i, "A" if i % 2 else "B", " ".join(random.Random(i).choices("abcdef", k=1 + i % 7))) for i in range(40)] + [(99, "A", None)], "doc_id long, part string, text string")
    queries = spark.createDataFrame([("q", "a b b"), ("r", "f zz")], "query_id string, query string")
    rows = incremental.indexed(docs)
    got = incremental.scores(rows, incremental.maintained("part")({}, rows, None), queries, "part")
    want = bm25.bm25_by_partition(docs, queries, "part")
    key = lambda df: sorted((r.query_id, r.part, r.doc_id, round(r.score, 9)) for r in df.collect())
    assert key(got) == key(want) != []


def vectors_of(spark, n=600, copies=200):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).astype(float).tolist(), f"t{i % 3}", f"d{i % 5}") for i in range(n)]
    rows += [(n + i, rows[0][1], "t0", "d0") for i in range(copies)]
    rows += [(9000, None, "t0", "d0"), (9001, [0.0] * 8, "t0", "d0"), (9002, [float("nan")] * 8, "t0", "d0"), (9003, [], "t0", "d0")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, ticker string, report_date string").repartition(5)


def brute_nearest(rows, q, k, ticker=None, dates=None):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    able = [(i, v) for i, v, t, d in rows if i < 9000 and (ticker is None or t in ticker) and (dates is None or d in dates)]
    scored = sorted((-round(float(unit(v) @ unit(q)), 9), i) for i, v in able)
    return [i for _, i in scored[:k]], [s for s, _ in scored[:k]]


def test_vector_index(spark, monkeypatch):
    """Chunks and blocks are small here, so that the list of the copies is cut. Reading everything is exact; calibrated reading finds nine of ten."""
    monkeypatch.setattr(vector_index, "CHUNK", 64)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(vector_index, "ROWS_EACH", 2)
    rows, df = vectors_of(spark)
    index = vector_index.VectorIndex.build(df, ("ticker", "report_date"))
    assert index.rows.count() == 800 and index.sizes.agg(F.sum("n")).first()[0] == 800
    assert index.rows.groupBy("list", "chunk").count().agg(F.max("count")).first()[0] < 128
    asked = [(i, rows[i][1], [None, ["t1"], ["t0", "t2"]][i % 3], [None, ["d1", "d2"]][i % 2]) for i in range(1, 40)]
    queries = spark.createDataFrame(asked, "query_id long, q array<double>, f_ticker array<string>, f_report_date array<string>")

    def results(share):
        found = {}
        for r in index.search(queries, 5, share).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        return found

    exact = results(1.0)
    for i, q, tickers, dates in asked:
        ids, scores = brute_nearest(rows, q, 5, tickers, dates)
        assert [-s for s in scores] == pytest.approx([s for _, s in exact[i]]) and len(exact[i]) == 5
    shares = index.calibrated(queries, 5)
    assert set(shares) == {0, 1, 2, 3} and all(0 < s <= 1 for s in shares.values())
    found = results(shares)
    hits = sum(len({v for v, _ in exact[i]} & {v for v, _ in found[i]}) for i in exact)
    assert hits >= 0.9 * sum(map(len, exact.values())) and all(len(found[i]) == 5 for i in exact)


def test_vector_index_saved_and_loaded(spark, tmp_path):
    rows, df = vectors_of(spark, 60, 0)
    index = vector_index.VectorIndex.build(df)
    index.save(str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, rows[1][1])], "query_id long, q array<double>")
    again = vector_index.VectorIndex.load(spark, str(tmp_path / "index"))
    assert again.search(queries, 3).collect() == index.search(queries, 3).collect() != []


def brute_ranks(rows):
    out = {}
    for q, d, f, t, s in rows:
        ahead = [r for r in rows if r[0] == q and (-r[4], r[1]) < (-s, d)]
        own = sum(r[2] == f and r[3] == t for r in ahead)
        tick = sum(r[3] == t for r in ahead)
        out[q, d] = (len(ahead) + 1, own + 1, tick - own, len(ahead) - tick)
    return out


@pytest.mark.parametrize("fanout", [64, 3])
def test_ranks_by_counting(spark, monkeypatch, fanout):
    monkeypatch.setattr(goldrank, "FANOUT", fanout)
    rng = random.Random(fanout)
    rows = [(q, d, rng.choice(["f1", "f2", None]), rng.choice(["A", "B", None]), float(rng.randrange(12))) for q in "xyz" for d in range(60) if rng.random() < 0.8]
    order = spark.createDataFrame(rows, "query_id string, doc_id long, filing string, ticker string, score double").repartition(7)
    want = brute_ranks(rows)
    columns = ("rank", "own_filing_rank", "other_filing_ahead", "other_ticker_ahead")
    assert {(r.query_id, r.doc_id): tuple(r[c] for c in columns) for r in goldrank.rank_stats(order).collect()} == want
    named = [(q, d) for q in "xyw" for d in range(0, 60, 4)]
    gold = spark.createDataFrame(named + named[:3], "query_id string, doc_id long")
    got = {(r.query_id, r.doc_id): tuple(r[c] for c in columns) for r in goldrank.gold_ranks(order, gold).collect()}
    assert got == {k: v for k, v in want.items() if k in named}
    assert goldrank.gold_ranks(order.limit(0), gold).count() == 0


@pytest.mark.parametrize("size", [16_000_000, 40])
def test_patterns_against_find(spark, monkeypatch, size):
    """With a small bound the strings are dealt to several automata."""
    monkeypatch.setattr(patterns, "AUTOMATON_BYTES", size)
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("ab ç") for _ in range(rng.randrange(60)))) for i in range(80)] + [(900, None), (901, ""), (902, "aé" * 400)]
    needles = sorted({"".join(rng.choice("ab ç") for _ in range(rng.randrange(1, 5))) for _ in range(40)}) + ["", None, "éa"]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(needles)] + [(500, needles[0])], "item long, needle string")
    got = sorted(tuple(r) for r in patterns.occurrences(docs, asked, 3).select("item", "doc_id", "start", "snippet").collect())
    pairs = [(i, n) for i, n in enumerate(needles)] + [(500, needles[0])]
    assert got == sorted((i, d, at, t[max(0, at - 3) : at + len(n) + 3]) for i, n in pairs if n for d, t in texts if t and (at := t.find(n)) >= 0)


def test_containment_by_key_and_absence(spark):
    docs = spark.createDataFrame([(1, "The  cat\nsat", "k1"), (2, "cat sat", "k2"), (3, None, "k1")], "doc_id long, text string, accession string")
    gold = spark.createDataFrame([(7, "cat  sat", "k2"), (8, "dog", "k1")], "item_id long, anchor string, accession string")
    assert [(r.item_id, r.doc_id) for r in corpus.containment(gold, docs, "accession").collect()] == [(7, 2)]
    assert sorted((r.item_id, r.doc_id, r.snippet) for r in corpus.containment(gold.drop("accession"), docs).collect()) == [(7, 1, "The cat sat"), (7, 2, "cat sat")]
    folded = spark.createDataFrame([(1, "A", "the cat sat"), (2, "A", "concat"), (3, "B", "")], "doc_id long, part string, folded string")
    terms = spark.createDataFrame([("Cat", "cat"), ("none", "none"), ("empty", "")], "term string, folded string")
    got = {(r.part, r.term): (r.n, r.first_doc, r.snippet) for r in corpus.absence(folded, terms).collect()}
    assert got["A", "Cat"] == (1, 1, "the cat sat") and got["B", "Cat"] == (0, None, None) and got["A", "empty"] == (0, None, None) and len(got) == 6


@pytest.mark.parametrize("name", ["index_update_rows", "index_update_statistics", "bm25_from_index", "vector_index_recall", "gold_ranks_by_count", "gold_snippets"])
def test_queries(spark, sf_dir, name):
    from factloom import catalog

    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)
