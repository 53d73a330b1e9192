"""Which candidates a question gets: how many, from which tiers, and which of them stay in its context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import rules
from corvane.functions.text import any_of

# Results of the preferred types that suffice, FAQ rows a question gets at least, and the head by which rows are the same.
ENOUGH, LEAST_FAQ, HEAD = 3, 2, 100
#: Candidates up to which reranking changes nothing.
FEW = 3


def candidate_count(intent: Column, with_department: Column, least: int) -> Column:
    """How many rows to search for: the intent's number, ``least`` at least, 20 for courses of a department."""
    counts = F.create_map(*(F.lit(x) for pair in rules.INTENT_CANDIDATES.items() for x in pair))
    n = F.greatest(F.lit(least), F.coalesce(F.try_element_at(counts, intent), F.lit(least)))
    return F.when((intent == "COURSE_INFO") & with_department, F.greatest(F.lit(20), n)).otherwise(n)


def allowed_types(rows: DataFrame, types: str, wanted: Column) -> Column:
    """Whether a row is for the wanted student type: rows that name none are for all."""
    return (F.coalesce(F.size(types), F.lit(0)) <= 0) | F.array_contains(types, wanted)


def tiered(found: DataFrame, keyword: DataFrame, preferred: Sequence[str], k: int, faq_fetch: int = 5) -> DataFrame:
    """(query_id, doc_key, phase, rank): candidates in the order in which the tiers give them.

    found: (query_id, doc_key, doc_type, head, score), every scored row of a query. Tier 1: the best ``k`` of the
    preferred types. 2: if these are fewer than ENOUGH, the best ``k`` of all. 3: if FAQ is preferred and fewer than
    LEAST_FAQ are there, so many of the best ``faq_fetch`` FAQ rows as are lacking. 4: the rows of ``keyword``
    (query_id, doc_key, doc_type, head, rank). A row whose head an earlier row has is left out.
    """
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_key")
    best = lambda rows, n: rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).drop("score")
    query = Window.partitionBy("query_id")
    columns = ["query_id", "doc_key", "doc_type", "head", "phase", "place"]
    one = best(found.where(F.col("doc_type").isin(*preferred)), k).withColumn("phase", F.lit(1)).select(columns)
    enough = one.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= ENOUGH).select("query_id")
    two = best(found, k).join(enough, "query_id", "left_anti").withColumn("phase", F.lit(2)).select(columns)
    dense = _first_heads(one.unionByName(two), keep_phase=1)
    if "faq" in preferred:
        faq = best(found.where("doc_type = 'faq'"), faq_fetch).withColumn("phase", F.lit(3)).select(columns)
        have = dense.groupBy("query_id").agg(F.count_if(F.col("doc_type") == "faq").alias("have"))
        more = _first_heads(dense.unionByName(faq), keep_phase=1).where("phase = 3").join(have, "query_id", "left").withColumn("lack", LEAST_FAQ - F.coalesce("have", F.lit(0)))
        nth = F.row_number().over(query.orderBy("place"))
        dense = dense.unionByName(more.withColumn("nth", nth).where("nth <= lack").select(columns))
    four = keyword.select("query_id", "doc_key", "doc_type", "head", F.lit(4).alias("phase"), F.col("rank").alias("place"))
    every = _first_heads(dense.unionByName(four), keep_phase=1)
    return every.withColumn("rank", F.row_number().over(query.orderBy("phase", "place"))).select("query_id", "doc_key", "phase", "rank")


def _first_heads(rows: DataFrame, keep_phase: int) -> DataFrame:
    """The first row with each head; those of ``keep_phase`` all stay."""
    nth = F.row_number().over(Window.partitionBy("query_id", "head").orderBy("phase", "place"))
    return rows.withColumn("_nth", nth).where((F.col("_nth") == 1) | (F.col("phase") == keep_phase)).drop("_nth")


def needs_rerank(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rerank``: whether their query has more than FEW of them."""
    return rows.withColumn("rerank", F.count("*").over(Window.partitionBy("query_id")) > FEW)


def on_topic(rows: DataFrame, topic: Sequence[str], asked: Column) -> DataFrame:
    """Of queries that ask about the topic the rows that mention it and those of the graph; all, if there are none."""
    keep = (F.col("channel") == "graph") | any_of(F.lower("text"), topic)
    return _or_all(rows, ~asked | keep)


def off_topic(rows: DataFrame, topic: Sequence[str], asked: Column) -> DataFrame:
    """Of queries that don't ask about the topic the rows that don't begin with it and those of the graph; all, if there are none."""
    keep = (F.col("channel") == "graph") | ~any_of(F.substring(F.lower("text"), 1, 200), topic)
    return _or_all(rows, asked | keep)


def _or_all(rows: DataFrame, keep: Column) -> DataFrame:
    some = F.max(F.coalesce(keep, F.lit(False))).over(Window.partitionBy("query_id"))
    return rows.withColumn("_keep", F.coalesce(keep, F.lit(False)) | ~some).where("_keep").drop("_keep")


def by_focus(rows: DataFrame, intent: Column, least: int = 3) -> DataFrame:
    """``rows`` (query_id, text, rank) ranked anew: those with a focus word of the intent first, where a query has more than ``least``."""
    hit = F.lit(False)
    for name, words in rules.FOCUS_WORDS.items():
        hit = hit | ((intent == name) & any_of(F.col("text"), words))
    query = Window.partitionBy("query_id")
    first = F.when((F.count("*").over(query) > least) & hit, 0).otherwise(1)
    return rows.withColumn("_first", first).withColumn("rank", F.row_number().over(query.orderBy("_first", "rank"))).drop("_first")


# The factor of rows for other student groups, notices beside other results, results sent to a page, and the head by which retried rows are the same.
OTHER_GROUP, SERIALISED, RETRY_HEAD = 0.6, 10, 120


def for_group(rows: DataFrame, own: Column) -> DataFrame:
    """``rows`` (group, score) with the scores of rows for another group than ``own`` lowered; rows of no group are for all."""
    other = (F.coalesce("group", F.lit("")) != "") & own.isNotNull() & (F.col("group") != own)
    return rows.withColumn("score", F.when(other, F.col("score") * OTHER_GROUP).otherwise(F.col("score")))


def notice_quota(rows: DataFrame) -> DataFrame:
    """``rows`` (query_id, channel, direct, rank) less the notices beyond their query's quota: none beside a direct answer, one beside two results, else two."""
    query = Window.partitionBy("query_id")
    notice = F.col("channel") == "notice"
    quota = F.when(F.max(F.coalesce(F.col("direct") & ~notice, F.lit(False))).over(query), 0).when(F.count_if(~notice).over(query) >= 2, 1).otherwise(2)
    nth = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("rank"))
    return rows.withColumn("_quota", quota).withColumn("_nth", nth).where(~notice | (F.col("_nth") <= F.col("_quota"))).drop("_quota", "_nth")


def with_retry(first: DataFrame, again: DataFrame) -> DataFrame:
    """Rows (query_id, channel, text, rank) of a search and its retry in that order, each head of a channel once, rows without text left out."""
    rows = first.withColumn("_run", F.lit(0)).unionByName(again.withColumn("_run", F.lit(1))).withColumn("_head", F.substring("text", 1, RETRY_HEAD)).where("_head != ''")
    nth = F.row_number().over(Window.partitionBy("query_id", "channel", "_head").orderBy("_run", "rank"))
    rows = rows.withColumn("_nth", nth).where("_nth = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("_run", "rank"))).drop("_run", "_head", "_nth")


def serialised(rows: DataFrame) -> DataFrame:
    """The first SERIALISED rows of each query as they are sent: scores of four digits, empty texts for what is missing."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    return rows.where(F.col("rank") <= SERIALISED).withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {"score": F.round(F.coalesce("score", F.lit(0.0)), 4)})
