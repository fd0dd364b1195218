"""Corpus upkeep: manifest difference, index plan, identity, absence of terms, duplicate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.patterns import occurrences


def manifest(files: DataFrame) -> DataFrame:
    """(relpath, sha, accession) of files (relpath, content, accession)."""
    return files.select("relpath", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256).alias("sha"), "accession")


def manifest_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(relpath, action): add, replace, delete or unchanged."""
    p, c = previous.select("relpath", F.col("sha").alias("old")), current.select("relpath", F.col("sha").alias("new"))
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "replace").otherwise("unchanged")
    return p.join(c, "relpath", "full_outer").select("relpath", action.alias("action"))


def rebuild_reason(forced: Column, sidecar: Column, manifest_ok: Column, recipe_same: Column, collection: Column, rows_same: Column) -> Column:
    """First reason for a full rebuild, or null: then the difference is enough."""
    return (
        F.when(forced, "forced").when(~sidecar, "no_sidecar").when(~manifest_ok, "bad_manifest").when(~recipe_same, "recipe_changed")
        .when(~collection, "collection_missing").when(~rows_same, "row_count")
    )


def corpus_identity(files: DataFrame, fanout: int = 1000, levels: int = 3) -> DataFrame:
    """One row (files, sha): a digest tree over files in the order of ``ord``. Each level joins the digests of ``fanout`` neighbours,
    so no task holds the digests of all files: the root of three levels joins one digest for a thousand million files each."""
    level = files.select(F.col("ord"), F.lit(1).cast("long").alias("n"), F.sha2(F.concat(F.col("relpath"), F.lit("\0"), F.col("sha")), 256).alias("d"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "d"))), lambda x: x["d"]), ""), 256)
    for _ in range(levels):
        level = level.groupBy(F.floor(F.col("ord") / fanout).alias("ord")).agg(F.sum("n").alias("n"), joined.alias("d"))
    return level.agg(F.sum("n").alias("files"), F.substring(joined, 1, 12).alias("sha"))


def absence(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(part, term, n, first_doc, snippet) of each part and term (term, folded): how many documents (doc_id, part, folded) of the part
    hold the term as whole words, the first of them and what stands around the term in it."""
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    needles = terms.select("term", F.when(F.col("folded") != "", padded("folded")).alias("needle"))
    found = occurrences(docs.select("doc_id", "part", padded("folded").alias("text")), needles)
    counts = found.groupBy("part", "term").agg(F.count_distinct("doc_id").alias("n"), F.min(F.struct("doc_id", F.trim("snippet").alias("snippet"))).alias("_first"))
    pairs = docs.select("part").distinct().crossJoin(F.broadcast(terms.select("term")))  # parts x a stated list of terms
    return pairs.join(counts, ["part", "term"], "left").select("part", "term", F.coalesce("n", F.lit(0)).alias("n"), F.col("_first.doc_id").alias("first_doc"), F.col("_first.snippet").alias("snippet"))


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: str = "id", shown: int = 5) -> DataFrame:
    """The rows themselves, or an error that names the first repeated ids; only these few reach the driver."""
    repeated = [str(r[key]) for r in duplicate_ids(rows, key).orderBy(key).limit(shown).collect()]
    if repeated:
        raise ValueError(f"repeated {key}: {', '.join(repeated)}")
    return rows


def containment(gold: DataFrame, docs: DataFrame, key: str | None = None) -> DataFrame:
    """(item_id, doc_id, snippet): gold anchors (item_id, anchor) that a document (doc_id, text) contains, white space collapsed.
    With ``key``, a column of both, only in documents of the same key, as a filing's accession."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    own = [F.col(key).alias("_key")] if key else []
    needles = gold.select("item_id", flat(F.col("anchor")).alias("needle"), *own)
    found = occurrences(docs.select("doc_id", flat(F.col("text")).alias("text"), *([F.col(key).alias("_other")] if key else [])), needles)
    return (found.where("_key = _other") if key else found).select("item_id", "doc_id", "snippet")
