"""Registered corpus queries against their SQL, and the pipeline against its stages one by one."""

import duckdb
import pytest

import corpus_pipeline
from factloom.llm import catalog, toxicity
from tests.llm.test_small import brute_components
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_every_row(spark, sf_dir, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert catalog.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_held_out_recall(spark):
    """A model that finds nothing has recall 0 and an area under the curve of a half."""
    sf_dir = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in catalog.QUERIES["op4_toxicity"](spark, sf_dir).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf_dir}/labels.parquet'").fetchall())
    toxic, clean = ([scored[d] for d, y in truth.items() if y == want and scored[d].held_out] for want in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) > 0 and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    above = sum((t.score > c.score) + (t.score == c.score) / 2 for t in toxic for c in clean)
    assert above > 0.93 * len(toxic) * len(clean)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    model = toxicity.train(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text)[0] < 0.5}
    lines = corpus_pipeline.drop_lines(spark, kept, sf_dir)
    assert lines.count() == kept.count() and all(r.text is None or r.n_chars == len(r.text) for r in lines.collect())
    unique = corpus_pipeline.drop_near_duplicates(spark, lines, sf_dir)
    want = {d for d, (_, c) in brute_components([(r.doc_id, r.text) for r in lines.collect()]).items() if d == c}
    assert {r.doc_id for r in unique.collect()} == want
    mixed = corpus_pipeline.mix_sources(spark, unique, sf_dir)
    assert 0 < mixed.count() <= unique.count()
    assert kept.columns == lines.columns == unique.columns == mixed.columns == columns
    assert corpus_pipeline.run(spark, sf_dir).count() == mixed.count() < before
