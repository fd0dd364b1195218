"""Rank-of-gold diagnostics: where the gold passages of a question stand in the retrieved order, and why they were missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import figure_fits, figures_in
from factloom.sources.shared import written

#: Pool size, rank in the own filing from which a miss is a dilution.
POOL = 25
OWN_FILING = 10


#: Gold places in a node of the tree that rows go down.
FANOUT = 64


def _with_rank(out: DataFrame, placed: DataFrame, name: str, groups: list[str]) -> DataFrame:
    """Adds a row's number in its groups: its place in its task's part of a group plus the sizes of the parts before.

    ``placed`` has ``_part`` and ``_pos`` of rows sorted over all tasks; ``out`` is it or made from it.
    """
    sizes = placed.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = sizes.select(*(F.col(c).alias(f"_k_{c}") for c in (*groups, "_part")), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_part").orderBy("_pos")
    same = F.col("_part") == F.col("_k__part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    out = out.join(before, same).drop(*(f"_k_{c}" for c in (*groups, "_part")))
    return out.withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("int")).drop("_before")


def _sorted(order: DataFrame, keys: list[Column], name: str) -> DataFrame:
    placed = order.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(placed.withColumn("_pos", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), name)


def rank_stats(order: DataFrame) -> DataFrame:
    """Adds to ranked rows (query_id, doc_id, filing, ticker, score): rank, rank in the own filing, and how many rows ahead
    belong to other filings of the same ticker and to other tickers.

    Rows are sorted over all tasks; a row's rank is its place in its task's part of a query plus the sizes of the parts before. So no
    task holds the order of a whole query, however many rows one has. Where only some rows' ranks are asked for, ``gold_ranks``
    needs no sort at all.
    """
    placed = _sorted(order, [F.col("query_id"), F.col("score").desc(), F.col("doc_id")], "order")
    out = placed
    for name, groups in (("rank", ["query_id"]), ("_ticker_rank", ["query_id", "ticker"]), ("own_filing_rank", ["query_id", "ticker", "filing"])):
        out = _with_rank(out, placed, name, groups)
    return out.withColumns({"other_filing_ahead": F.col("_ticker_rank") - F.col("own_filing_rank"), "other_ticker_ahead": F.col("rank") - F.col("_ticker_rank")}).drop("_ticker_rank", "_pos", "_part")


def gold_ranks(order: DataFrame, gold: DataFrame) -> DataFrame:
    """The columns of ``rank_stats`` for the rows of order (query_id, doc_id, filing, ticker, score) that gold (query_id, doc_id) names.

    Every row is counted once into the interval between two gold rows of its query that it falls in; ranks are sums of counts.
    A row finds its interval in a tree over the query's sorted gold places with ``FANOUT`` places a node, so it meets one node a
    level however many gold rows there are, and the same levels sum up the intervals ahead: no group holds more than a node's.
    Only gold rows are sorted. Gold rows that are not in the order, for which there is no rank, have no row. Each row is named once.
    """
    order = written(order.select("query_id", "doc_id", "ticker", "filing", "score"), "order")  # read twice, made once
    place = F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"))
    named = order.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    placed = _sorted(named, [F.col("query_id"), F.col("score").desc(), F.col("doc_id")], "gold")
    own = written(_with_rank(placed, placed, "_own", ["query_id"]).drop("_pos", "_part").withColumn("_own", F.col("_own").cast("long")), "ranked-gold")
    most = own.agg(F.max("_own")).first()[0] or 0
    levels = next(d for d in range(1, 99) if FANOUT**d > most)

    def node(c: str, level: int) -> Column:
        return F.floor(F.col(c) / F.lit(FANOUT**level))

    counted = order.withColumn("_node", F.lit(0).cast("long"))
    places = own.select("query_id", (F.col("_own") - 1).alias("_g"), place.alias("_place"))
    for level in range(levels, 0, -1):
        keys = places.where(F.col("_g") % FANOUT ** (level - 1) == 0).groupBy("query_id", node("_g", level).alias("_node")).agg(F.array_sort(F.collect_list("_place")).alias("_keys"))
        passed = F.size(F.filter("_keys", lambda key: key <= place))
        inner = level > 1  # down to the last child that does not begin behind the row; at a leaf, the gold rows up to the row's place
        counted = counted.join(keys, ["query_id", "_node"]).withColumn("_node", F.col("_node") * FANOUT + (F.greatest(passed - 1, F.lit(0)) if inner else passed)).drop("_keys")
    counted = written(counted.groupBy("query_id", F.col("_node").alias("_own"), "ticker", "filing").agg(F.count("*").alias("n")), "intervals")

    def spread(rows: DataFrame) -> DataFrame:
        """Each row for all rows, those of its ticker and those of its filing, at every level of the tree."""
        none = F.lit(None)
        kinds = [F.struct(F.lit(kind).alias("kind"), t.cast("string").alias("t"), f.cast("string").alias("f")) for kind, t, f in (("_all", none, none), ("_ticker", F.col("ticker"), none), ("_filing", F.col("ticker"), F.col("filing")))]
        nodes = [F.struct(F.lit(level).alias("level"), node("_own", level).alias("node")) for level in range(levels)]
        return rows.withColumn("_kind", F.explode(F.array(*kinds))).withColumn("_level", F.explode(F.array(*nodes))).select("*", "_kind.*", "_level.*").drop("_kind", "_level")

    sums = spread(counted).groupBy("query_id", "kind", "t", "f", "level", "node").agg(F.sum("n").alias("n"))
    siblings = Window.partitionBy("query_id", "kind", "t", "f", "level", F.floor(F.col("node") / FANOUT)).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("n", F.sum("n").over(siblings)).where("n is not null")
    on, asked = ("query_id", "kind", "t", "f", "level", "node"), spread(own)
    same = [asked[c].eqNullSafe(sums[c]) if c in "tf" else asked[c] == sums[c] for c in on]
    row = ("query_id", "doc_id", "ticker", "filing", "score")
    ahead = asked.join(sums, same, "left").select(*(asked[c] for c in (*row, "kind")), "n").groupBy(*row).pivot("kind", ["_all", "_ticker", "_filing"]).agg(F.coalesce(F.sum("n"), F.lit(0)))
    return ahead.select(
        "query_id", "doc_id", "ticker", "filing", "score", (F.col("_all") + 1).cast("int").alias("rank"), (F.col("_filing") + 1).cast("int").alias("own_filing_rank"),
        (F.col("_ticker") - F.col("_filing")).cast("int").alias("other_filing_ahead"), (F.col("_all") - F.col("_ticker")).cast("int").alias("other_ticker_ahead"),
    )


def better(a: str, b: str) -> Column:
    """The better of two rank structs: the smaller rank, the first on ties; null counts as last."""
    infinite = F.lit(2**31 - 1)
    return F.when(F.coalesce(F.col(a)["rank"], infinite) <= F.coalesce(F.col(b)["rank"], infinite), F.col(a)).otherwise(F.col(b))


def miss_class() -> Column:
    """Class of a gold row with final_rank, pool_pos, scope_excluded, and rank structs ``bm25`` and ``vector``."""
    best = better("bm25", "vector")
    return (
        F.when(F.col("final_rank").isNotNull(), "hit").when(F.col("pool_pos").isNotNull(), "rerank").when(F.col("scope_excluded"), "scope_excluded")
        .when(F.col("bm25").isNull() & F.col("vector").isNull(), "unranked").when(F.col("vector")["rank"] <= POOL, "index_recall")
        .when(best["own_filing_rank"] > OWN_FILING, "dilution").when(best["other_filing_ahead"] >= F.greatest(best["other_ticker_ahead"], F.lit(1)), "period_confusion").otherwise("other_ticker")
    )


def rerank_cause(top: int = 5) -> Column:
    """Why a pooled chunk missed the top: columns combined_rank, ce_rank, rescuable, table_in_final, pool_pos, pool."""
    return (
        F.when(F.col("combined_rank") <= top, "rescue").when(F.col("ce_rank") <= top, "fusion")
        .when(F.col("rescuable") & ~F.col("table_in_final") & (F.col("pool_pos") > F.floor(F.col("pool") / 2)), "rescue_threshold").otherwise("model")
    )


def best_gold(records: DataFrame) -> DataFrame:
    """Best gold row of each (query_id, part): final rank, pool position, in scope, better diagnostic rank; nulls last."""
    best = better("bm25", "vector")["rank"]
    order = Window.partitionBy("query_id", "part").orderBy(F.col("final_rank").asc_nulls_last(), F.col("pool_pos").asc_nulls_last(), F.col("scope_excluded"), best.asc_nulls_last(), "doc_id")
    return records.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def coverage(parts: DataFrame) -> DataFrame:
    """(qid, covered) of rows (qid, part, query_id, hit): every part must be hit by some query."""
    by_part = parts.groupBy("qid", "part").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"))
    return by_part.groupBy("qid").agg(F.bool_and("hit").alias("covered"))


def summary(parts: DataFrame) -> DataFrame:
    """Hits and classes of own-period and other rows, and over all: own_period, class, n, hit_rate."""
    return parts.rollup("own_period", "class").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def lost_hits(base: DataFrame, new: DataFrame) -> DataFrame:
    """Hits (query_id, ticker, qid, part) of ``base`` that ``new`` lacks; a null ticker equals a null ticker."""
    keys = ["query_id", "ticker", "qid", "part"]
    same = [base[k].eqNullSafe(new[k]) for k in keys]
    condition = same[0] & same[1] & same[2] & same[3]
    return base.join(new, condition, "left_anti").select(*keys)


def query_set(searches: DataFrame, ids: DataFrame, gold: DataFrame) -> DataFrame:
    """Distinct (query, ticker) of searches (run_id, ord, query, ticker) with the sorted ids of their questions that have gold."""
    named = searches.join(ids, "run_id").join(gold.select("qid").distinct(), "qid", "left_semi")
    return named.groupBy("query", "ticker").agg(F.array_sort(F.collect_set("qid")).alias("qids"), F.min("ord").alias("first_seen"))


def query_set_drops(searches: DataFrame, ids: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (unjoined, no_gold): searches whose run has no known question (no id, or '?'), and those whose question has no gold."""
    known = gold.select("qid").distinct().withColumn("_gold", F.lit(True))
    joined = searches.join(ids, "run_id", "left").join(known, "qid", "left")
    unjoined = F.coalesce(F.col("qid"), F.lit("?")) == "?"
    return joined.agg(F.count_if(unjoined).alias("unjoined"), F.count_if(~unjoined & F.col("_gold").isNull()).alias("no_gold"))


def queries_of_report(report: DataFrame) -> DataFrame:
    """The queries (query, ticker, qids) that a base report (variant ``report``) was made of, so that a comparison asks the same."""
    queries = F.explode(F.try_variant_get("report", "$.queries", "array<struct<query:string,ticker:string,qids:array<string>>>"))
    return report.select(queries.alias("q")).select("q.query", "q.ticker", "q.qids")


def filter_queries(queries: DataFrame, wanted: list[str] | None) -> DataFrame:
    """Queries of any wanted question, with only those questions; all queries if none is named."""
    if not wanted:
        return queries
    kept = queries.withColumn("qids", F.array_intersect("qids", F.array(*map(F.lit, wanted))))
    return kept.where(F.size("qids") > 0)


def with_ranks(gold: DataFrame, **tables: DataFrame) -> DataFrame:
    """gold (query_id, doc_id) with the rank of each named table (query_id, doc_id, rank); null where a table lacks the row."""
    for name, df in tables.items():
        gold = gold.join(df.select("query_id", "doc_id", F.col("rank").alias(name)), ["query_id", "doc_id"], "left")
    return gold


def propose_gold(parts: DataFrame, chunks: DataFrame, around: int = 120) -> DataFrame:
    """(id, part, doc_id, token, snippet): numbers of a part's own company's chunks that could be its expected figure.

    parts (id, part, ticker, value, unit, decimals); chunks (doc_id, ticker, text). Numbers are found once per chunk.
    """
    figures = chunks.select("doc_id", "ticker", "text", F.explode(figures_in(F.col("text"))).alias("f"))
    near = parts.join(figures, "ticker").where(figure_fits(F.col("f.magnitude"), F.col("value"), F.col("unit"), F.col("decimals")))
    start = F.greatest(F.col("f.start") - F.floor((around - F.length("f.token")) / 2), F.lit(0)).cast("int")
    return near.select("id", "part", "doc_id", F.col("f.token").alias("token"), F.trim(F.regexp_replace(F.col("text").substr(start + 1, F.lit(around)), r"\s+", " ")).alias("snippet"))
