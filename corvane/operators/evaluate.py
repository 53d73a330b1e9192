"""Answer and retrieval metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_overlap(pairs: DataFrame, key: str, predicted: Column, expected: Column) -> DataFrame:
    """(key, precision, recall, f1) by multisets of tokens; both empty is 1, one empty or nothing shared is 0."""
    side = lambda c, n: pairs.select(key, F.explode(c).alias("token")).groupBy(key, "token").agg(F.count("*").alias(n))
    shared = side(predicted, "p").join(side(expected, "e"), [key, "token"]).groupBy(key).agg(F.sum(F.least("p", "e")).alias("same"))
    sized = pairs.select(key, F.size(predicted).alias("np"), F.size(expected).alias("ne")).join(shared, key, "left").withColumn("same", F.coalesce("same", F.lit(0)))
    both = (F.col("np") == 0) & (F.col("ne") == 0)
    ratio = lambda n: F.when(both, 1.0).when(F.col("same") == 0, 0.0).otherwise(F.col("same") / F.col(n))
    f1 = F.when(both, 1.0).when(F.col("same") == 0, 0.0).otherwise(2 * F.col("same") / (F.col("np") + F.col("ne")))
    return sized.select(key, F.round(ratio("np"), 6).alias("precision"), F.round(ratio("ne"), 6).alias("recall"), F.round(f1, 6).alias("f1"))


def retrieval(found: DataFrame, gold: DataFrame, k: int | None = 5, tolerance: int = 0) -> DataFrame:
    """(query_id, recall, mrr) of found (query_id, rank, page) against gold (query_id, page); k None looks at every rank."""
    hit = found.join(gold.withColumnRenamed("page", "gold"), "query_id").where((F.abs(F.col("page") - F.col("gold")) <= tolerance) & (F.col("gold") != 0))
    if k is not None:
        hit = hit.where(F.col("rank") <= k)
    best = hit.groupBy("query_id").agg(F.min("rank").alias("best"))
    return gold.select("query_id").join(best, "query_id", "left").select("query_id", F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0).alias("recall"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("mrr"))


def classification(rows: DataFrame, answered: Column, right: Column, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; a wrong answer is both a false positive and a false negative."""
    tp, wrong, silent = (F.count_if(c) for c in (answered & right, answered & ~right, ~answered))
    counted = rows.groupBy(*by).agg(F.count("*").alias("total"), tp.alias("tp"), wrong.alias("fp"), (wrong + silent).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.select(*by, "total", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """p0, p50, p90, p95 and p100 by linear interpolation."""
    asked = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    return rows.groupBy(*by).agg(*(F.round(F.percentile(value, F.lit(q)), 6).alias(n) for n, q in asked.items()))


def threshold_grid(rows: DataFrame, first: str, second: str, label: str, firsts: list[float], seconds: list[float]) -> DataFrame:
    """(t1, t2, label, n_and, n_or): rows per label that pass both or either threshold, for each pair.

    Rows are counted once by how many thresholds of each kind they reach; the grid is summed over those counts.
    """
    reach = lambda c, ts: sum((F.when(F.col(c) >= t, 1).otherwise(0) for t in sorted(ts)), F.lit(0))
    cells = rows.groupBy(F.col(label).alias("label"), reach(first, firsts).alias("i"), reach(second, seconds).alias("j")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b, i + 1, j + 1) for i, a in enumerate(sorted(firsts)) for j, b in enumerate(sorted(seconds))], "t1 double, t2 double, gi int, gj int")
    one, two = F.col("i") >= F.col("gi"), F.col("j") >= F.col("gj")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return cells.crossJoin(F.broadcast(grid)).groupBy("t1", "t2", "label").agg(n(one & two).alias("n_and"), n(one | two).alias("n_or"))


def two_channel_ranks(rows: DataFrame, evidence: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall, mrr, channels): by the best rank up to k at which either channel of ``rows`` (query_id, channel,
    rank, page) has a page of ``evidence`` (query_id, page). Queries without evidence are left out; without a hit the
    channels are ``hybrid`` if the graph gave any row, else ``vector``.
    """
    graph = rows.groupBy("query_id").agg(F.max(F.col("channel") == "graph").alias("any_graph"))
    hits = rows.where(F.col("rank") <= k).join(evidence.distinct(), ["query_id", "page"]).groupBy("query_id")
    hits = hits.agg(F.min("rank").alias("best"), F.max(F.col("channel") == "graph").alias("g"), F.max(F.col("channel") == "vector").alias("v"))
    found = evidence.select("query_id").distinct().join(hits, "query_id", "left").join(graph, "query_id", "left")
    channels = F.when(F.col("g") & F.col("v"), "hybrid").when(F.col("g"), "graph").when(F.col("v"), "vector").when(F.coalesce("any_graph", F.lit(False)), "hybrid").otherwise("vector")
    return found.select("query_id", F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0).alias("recall"), F.coalesce(F.round(1 / F.col("best"), 6), F.lit(0.0)).alias("mrr"), channels.alias("channels"))
