"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import answer_queries, corpus_queries, eval_queries, fact_queries, index_queries, report_queries, retrieval_queries, source_queries

_MODULES = (retrieval_queries, fact_queries, eval_queries, corpus_queries, report_queries, index_queries, source_queries, answer_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
