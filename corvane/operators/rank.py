"""Reranking, fusion, cutoffs and context selection, all keyed by query_id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import fixed

TIER_ONE = ("domestic", "guide")
DOCUMENT_TYPES = ("domestic", "guide", "scholarship", "timetable", "notice_attachment")


def _query() -> Window:
    return Window.partitionBy("query_id")


def _by(score: str, tie: str) -> Window:
    return _query().orderBy(F.desc(score), tie)


def rerank(rows: DataFrame, top: int, tie: str = "doc_id") -> DataFrame:
    """Rows (query_id, tie, doc_type, pinned, has_url, asks_url, raw) with their score and rank, cut to the best.

    Bonuses are shares of the best raw score's size and exclude each other in order: first-tier types, FAQ, pinned
    notices, then URLs. From the fourth row on a score below half the best (if that is positive), or below -3, ends
    the list. If no document type is left, the best one with -3 or more takes the last place.
    """
    size = F.abs(F.max("raw").over(_query()))
    url = F.col("asks_url") & F.col("has_url")
    bonus = (
        F.when(F.col("doc_type").isin(*TIER_ONE), F.when(url, size * 0.04).otherwise(0.0))
        .when(F.col("doc_type") == "faq", size * 0.05)
        .when((F.col("doc_type") == "notice") & F.col("pinned"), size * 0.05)
        .when(url, size * 0.18)
        .otherwise(0.0)
    )
    scored = rows.withColumn("score", F.round(F.col("raw") + bonus, 6)).withColumn("place", F.row_number().over(_by("score", tie)))
    best = F.max("score").over(_query())
    floor = F.greatest(F.when(best > 0, best * 0.5).otherwise(F.lit(-1e300)), F.lit(-3.0))
    is_document = F.col("doc_type").isin(*DOCUMENT_TYPES)
    kept = scored.withColumn("kept", (F.col("place") <= top) & ((F.col("place") <= 3) | (F.col("score") >= floor))).withColumn("document", is_document)
    any_document = F.max(F.col("kept") & F.col("document")).over(_query())
    n_kept = F.count_if("kept").over(_query())
    spare = F.min(F.when(F.col("document") & ~F.col("kept") & (F.col("score") >= -3.0), F.col("place"))).over(_query())
    flagged = kept.withColumn("any_document", any_document).withColumn("n_kept", n_kept).withColumn("spare", spare)
    forced = ~F.col("any_document") & (F.col("place") == F.col("spare"))
    dropped = ~F.col("any_document") & F.col("spare").isNotNull() & (F.col("n_kept") >= top) & (F.col("place") == F.col("n_kept"))
    chosen = flagged.where((F.col("kept") & ~dropped) | forced)
    return chosen.withColumn("rank", F.row_number().over(_query().orderBy("place"))).drop("place", "kept", "document", "any_document", "n_kept", "spare")


def near_copies_out(rows: DataFrame, text: str = "text", prefix: int = 100, tie: str = "doc_id") -> DataFrame:
    """The best row of each text beginning; optional, not part of the default plan."""
    first = Window.partitionBy("query_id", F.substring(text, 1, prefix)).orderBy(F.desc("score"), tie)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def knee_cut(rows: DataFrame, least: int = 3, share: float = 0.25, span: float = 1.0, tie: str = "doc_id") -> DataFrame:
    """Rows before the largest fall after ``least`` rows, if it is over ``share`` of a range of ``span`` or more; optional."""
    order = _by("score", tie)
    steps = rows.withColumn("place", F.row_number().over(order)).withColumn("fall", F.lag("score").over(order) - F.col("score"))
    whole = F.max("score").over(_query()) - F.min("score").over(_query())
    cut = F.max_by(F.col("place"), F.when(F.col("place") > least, F.struct("fall", -F.col("place")))).over(_query())
    fall = F.max(F.when(F.col("place") > least, F.col("fall"))).over(_query())
    marked = steps.withColumn("cut", F.when((whole >= span) & (fall > share * whole), cut))
    return marked.where(F.col("cut").isNull() | (F.col("place") < F.col("cut"))).drop("place", "fall", "cut")


def weights(intent: Column, question_type: Column) -> tuple[Column, Column]:
    """(graph, vector) weights of an intent, changed by the question type."""
    table = F.create_map(*(x for k, (g, v) in fixed.INTENT_WEIGHTS.items() for x in (F.lit(k), F.struct(F.lit(g).alias("g"), F.lit(v).alias("v")))))
    factor = F.create_map(*(x for k, (g, v) in fixed.QUESTION_FACTORS.items() for x in (F.lit(k), F.struct(F.lit(g).alias("g"), F.lit(v).alias("v")))))
    w, f = F.try_element_at(table, intent), F.try_element_at(factor, question_type)
    return (F.coalesce(w[n], F.lit(d)) * F.coalesce(f[n], F.lit(1.0)) for n, d in zip("gv", fixed.DEFAULT_WEIGHTS, strict=True))


def fuse(rows: DataFrame, k: int = 10, tie: str = "doc_key") -> DataFrame:
    """Weighted reciprocal rank fusion of rows (query_id, tie, channel, rank, doc_type, pinned, graph_weight, vector_weight).

    Vector rows of first-tier types count 1.3 times, pinned notices 1.15 times; student records get 10 on top.
    """
    graph = F.col("channel") != "vector"
    factor = F.when(graph, 1.0).when(F.col("doc_type").isin(*TIER_ONE), 1.3).when((F.col("doc_type") == "notice") & F.col("pinned"), 1.15).otherwise(1.0)
    one = F.when(graph, F.col("graph_weight")).otherwise(F.col("vector_weight")) / (k + F.col("rank")) * factor + F.when(F.col("channel") == "transcript", 10.0).otherwise(0.0)
    scored = rows.groupBy("query_id", tie).agg(F.round(F.sum(one), 6).alias("score"), F.min("channel").alias("channel"), F.min("doc_type").alias("doc_type"))
    return scored.withColumn("rank", F.row_number().over(_by("score", tie)))


def adaptive_cut(rows: DataFrame, ratio: Column | float = 0.70, least: int = 3) -> DataFrame:
    """Rows (query_id, rank, score) up to the first whose score is below ``ratio`` of the first score under 1.

    At least ``least`` rows stay after that first one; lists without a positive one are left alone.
    """
    ref = F.min(F.when(F.col("score") < 1, F.col("rank"))).over(_query())
    ref_score = F.min_by("score", F.when(F.col("score") < 1, F.col("rank"))).over(_query())
    marked = rows.withColumn("_ref", ref).withColumn("_score", ref_score)
    low = (F.col("rank") > F.greatest(F.lit(least), F.col("_ref") - 1 + least)) & (F.col("_score") > 0) & (F.col("score") / F.col("_score") < ratio)
    cut = F.min(F.when(low, F.col("rank"))).over(_query())
    return marked.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("rank") < F.col("_cut"))).drop("_ref", "_score", "_cut")


def cross_boost(rows: DataFrame, factor: float = 1.2, tie: str = "doc_key") -> DataFrame:
    """Rows (query_id, tie, channel, page, score): those whose page both channels found count ``factor`` times; ranked anew."""
    page = Window.partitionBy("query_id", "page")
    both = F.max(F.col("channel") == "vector").over(page) & F.max(F.col("channel") != "vector").over(page) & F.col("page").isNotNull()
    return rows.withColumn("score", F.round(F.when(both, F.col("score") * factor).otherwise(F.col("score")), 6)).withColumn("rank", F.row_number().over(_by("score", tie)))


def in_order(rows: DataFrame, *keys: Column) -> DataFrame:
    """Ranked anew by ``keys``, otherwise in the order there is (as for FAQ promotion and focus)."""
    return rows.withColumn("rank", F.row_number().over(_query().orderBy(*keys, "rank")))


def select_context(rows: DataFrame, budget_tokens: Column, text: str = "text", chars_per_token: float = 1.5) -> DataFrame:
    """(query_id, rank, taken, used): the characters that each row gives to its query's context, in rank order.

    A row whose first 120 characters came before gives nothing; nor does any row once under 80 characters are left. One
    row gives at most 60% of the whole. Rows of a query are folded in order, as each choice depends on those before; a
    query has as many rows as its search returned.
    """
    most = F.floor(budget_tokens / chars_per_token).cast("int")
    trimmed = F.trim(F.col(text))
    listed = rows.where(F.col(text).isNotNull() & (trimmed != "")).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.length(text).alias("n"), F.substring(trimmed, 1, 120).alias("head")))).alias("rows"), F.max(most).alias("most")
    )
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<rank: int, taken: int>>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        left = F.col("most") - state["used"]
        fresh = ~F.array_contains(state["seen"], row["head"])
        take = F.when(fresh & (left >= 80), F.least(row["n"], left, F.floor(F.col("most") * 0.6).cast("int"))).otherwise(0)
        return F.struct(
            (state["used"] + take).alias("used"),
            F.array_union(state["seen"], F.array(row["head"])).alias("seen"),
            F.when(take > 0, F.concat(state["out"], F.array(F.struct(row["rank"].cast("int").alias("rank"), take.cast("int").alias("taken"))))).otherwise(state["out"]).alias("out"),
        )

    folded = listed.select("query_id", F.aggregate("rows", start, step).alias("s"))
    return folded.select("query_id", F.col("s.used").alias("used"), F.explode("s.out").alias("o")).select("query_id", "o.rank", "o.taken", "used")


def confidence(direct: Column, n_selected: Column, has_vector: Column, vector_top: Column, before_cut: Column, after_cut: Column) -> Column:
    """How far a context can be trusted, from 0 to 1."""
    base = F.when(n_selected >= 3, 0.8).when(n_selected == 2, 0.6).otherwise(0.4)
    moved = F.when(has_vector & (vector_top < 0), F.least(base, F.lit(0.3))).when(has_vector & (vector_top > 2), F.greatest(base, F.lit(0.8))).otherwise(base)
    cut = F.when((before_cut >= 5) & (after_cut <= before_cut * 0.6), F.least(moved, F.lit(0.4))).otherwise(moved)
    return F.when(direct, 1.0).when(n_selected == 0, 0.0).otherwise(cut)


def budget(intent: Column, table: Mapping[str, int] = fixed.BUDGETS) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), intent), F.lit(fixed.DEFAULT_BUDGET))
