"""Analytics over chat-log rows (id, ts, session, intent, duration, rating, question, answer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kpi(log: DataFrame, today: Column) -> DataFrame:
    """One row: all questions, those of ``today``, and the mean duration in seconds."""
    return log.agg(F.count("*").alias("total"), F.count_if(F.to_date("ts") == today).alias("today"), F.round(F.coalesce(F.avg("duration"), F.lit(0.0)) / 1000, 6).alias("avg_seconds"))


def daily(log: DataFrame, last: Column, days: int = 7) -> DataFrame:
    """(day, n) of the ``days`` days up to ``last``, zeros included."""
    spark = log.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = log.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def intents(log: DataFrame) -> DataFrame:
    """(intent, n, rank), the most common first, unnamed ones as GENERAL."""
    counts = log.groupBy(F.coalesce("intent", F.lit("GENERAL")).alias("intent")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "intent")))  # a row an intent


def summary(log: DataFrame, *by: str) -> DataFrame:
    """Per group: rows, mean duration and the commonest intent."""
    counts = log.groupBy(*by, "intent").agg(F.count("*").alias("n"), F.sum("duration").alias("d"))
    return counts.groupBy(*by).agg(F.sum("n").alias("total"), F.round(F.sum("d") / F.sum("n"), 6).alias("avg_ms"), F.max_by("intent", F.struct("n", F.col("intent"))).alias("top_intent"))


def recent(log: DataFrame, n: int = 10) -> DataFrame:
    stars = F.when(F.col("rating") > 0, F.repeat(F.lit("*"), F.col("rating").cast("int"))).otherwise("-")
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(n).select("id", F.date_format("ts", "MM-dd HH:mm").alias("time"), "intent", "duration", stars.alias("rating"))


def latest_rating(log: DataFrame, ratings: DataFrame) -> DataFrame:
    """The log with late ratings (session, question, rated_at, rating): each goes to the latest matching row of its own day."""
    last = log.withColumn("day", F.to_date("ts")).groupBy("session", "question", "day").agg(F.max_by("id", F.struct("ts", "id")).alias("id"))
    newest = ratings.groupBy("session", "question", F.to_date("rated_at").alias("day")).agg(F.max_by("rating", "rated_at").alias("new_rating"))
    chosen = last.join(newest, ["session", "question", "day"]).select("id", "new_rating")
    return log.join(chosen, "id", "left").withColumn("rating", F.coalesce("new_rating", "rating")).drop("new_rating")


def sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(session, begin, until, n): runs of rows of a session no more than ``gap`` apart."""
    grouped = log.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return grouped.select("session", F.col("w.start").alias("begin"), "last", "n")


def uncovered(log: DataFrame, since: Column, refused: Column) -> DataFrame:
    """Rows since a day that were refused, unanswered or rated 2 or less, with a question of two characters or more."""
    low = F.coalesce(F.col("rating") <= 2, F.lit(False))
    empty = F.coalesce(F.trim("answer"), F.lit("")) == ""
    return log.where((F.to_date("ts") >= since) & (F.length(F.trim("question")) >= 2) & (empty | refused | low))


def last_pairs(turns: DataFrame, session: str, n: int) -> DataFrame:
    """(session, user_turn, assistant_turn): the last ``n`` answers, each with the user's turn it is the first to answer."""
    said = turns.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    before = Window.partitionBy(session).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda role: F.max(F.when(F.col("role") == role, F.col("turn"))).over(before)
    pairs = said.select(session, "role", F.col("turn").alias("assistant_turn"), last("user").alias("user_turn"), last("assistant").alias("_a"))
    pairs = pairs.where((F.col("role") == "assistant") & F.col("user_turn").isNotNull() & (F.col("_a").isNull() | (F.col("_a") < F.col("user_turn"))))
    newest = Window.partitionBy(session).orderBy(F.desc("assistant_turn"))
    return pairs.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).select(session, "user_turn", "assistant_turn")
