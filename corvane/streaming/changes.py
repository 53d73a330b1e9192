"""Crawled pages as a stream: what is new or changed is applied as it comes; what is gone goes at the end of its crawl.

A crawl may come in any number of micro-batches: each page carries the crawl's number, and a row marked as the end says
that no more of it will come. Only then are pages deleted that the crawl didn't see. State and pages are versioned tables
of which a batch rewrites the parts that it touches; a batch that is run again after a failure starts from the version
before it and writes the same one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import tables
from corvane.streaming.versions import VersionedTable

STATE = "source_id string, content_hash string, first_seen timestamp, last_seen timestamp, seen_crawl long"
PAGES = "source_id string, content string"
#: What a stream of crawls has; source_id and content are null in a row that only marks the end.
CRAWL = "crawl_id long, source_id string, content string, crawled_at timestamp, is_end boolean"


def state_table(spark: SparkSession, folder: str) -> VersionedTable:
    return VersionedTable(spark, f"{folder.rstrip('/')}/state", STATE, "source_id")


def page_table(spark: SparkSession, folder: str) -> VersionedTable:
    return VersionedTable(spark, f"{folder.rstrip('/')}/table", PAGES, "source_id")


def _parts(rows: DataFrame, table: VersionedTable) -> set[int]:
    return {r["p"] for r in rows.select(table.part_of("source_id").alias("p")).distinct().collect()}  # no more than table.parts


def unseen(state: DataFrame, ended: list[int]) -> DataFrame:
    """Events of pages that a crawl which has ended didn't see, though it saw others of their scheme (pages without a scheme: whatever it saw)."""
    scheme = F.when(F.col("source_id").contains("://"), F.regexp_extract("source_id", "^(.*?)://", 1))
    known = state.withColumn("scheme", scheme)
    latest = known.where("scheme IS NOT NULL").groupBy(F.col("scheme").alias("s")).agg(F.max("seen_crawl").alias("latest"))
    last = max(ended)
    joined = known.join(latest, F.col("scheme") == F.col("s"), "left").where(F.col("scheme").isNull() | (F.col("latest") >= last))
    return joined.where(F.coalesce("seen_crawl", F.lit(-1)) < last).select("source_id", F.lit("DELETED").alias("change"), F.col("content_hash").alias("old_hash"), F.lit(None).cast("string").alias("new_hash"))


def apply_batch(batch: DataFrame, number: int, folder: str, fails: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One micro-batch of crawls (see CRAWL): the newest row of an id counts.

    fails: the events (source_id, ...) of those given that couldn't be applied; they are neither applied nor committed,
    so the next crawl finds them again.
    """
    spark = batch.sparkSession
    states, pages = state_table(spark, folder), page_table(spark, folder)
    rows = batch.persist()
    crawl = tables.newest(rows.where("source_id IS NOT NULL"), "source_id", F.desc("crawled_at"), F.desc("content")).withColumn("content_hash", F.sha2("content", 256)).persist()
    ended = [r["crawl_id"] for r in rows.where("is_end").select("crawl_id").distinct().collect()]
    touched = _parts(crawl, states)
    version = states.before(number)
    # a crawl's end is held against all of the state (short rows), a part of a crawl against the parts that it touches
    state = states.read(version, None if ended else touched)
    seen = crawl.groupBy("source_id").agg(F.max("crawl_id").alias("_crawl"))
    events = tables.changes(state.select("source_id", "content_hash"), crawl.select("source_id", "content_hash")).where("change <> 'DELETED'")
    marked = state.join(seen, "source_id", "left").withColumn("seen_crawl", F.greatest("seen_crawl", "_crawl")).drop("_crawl")
    if ended:
        arrived = crawl.join(state.select("source_id"), "source_id", "left_anti").select("source_id", F.col("content_hash"), F.col("crawled_at").alias("first_seen"), F.col("crawled_at").alias("last_seen"), F.col("crawl_id").alias("seen_crawl"))
        events = events.unionByName(unseen(marked.unionByName(arrived), ended))
    events = events.persist()
    failed = fails(events).select("source_id") if fails else events.limit(0).select("source_id")
    failed = failed.persist()
    done = events.join(failed, "source_id", "left_anti")
    at = crawl.agg(F.max("crawled_at").alias("at")).first()["at"]
    committed = tables.commit_state(marked.drop("seen_crawl"), events, failed, F.lit(at).cast("timestamp"))
    numbers = marked.select("source_id", F.col("seen_crawl").alias("_was")).join(seen, "source_id", "full").select("source_id", F.greatest("_was", "_crawl").alias("seen_crawl"))
    committed = committed.join(numbers, "source_id", "left").select("source_id", "content_hash", "first_seen", "last_seen", "seen_crawl")
    changed = _parts(done, pages)
    pages.write(tables.apply_changes(pages.read(pages.before(number), changed), done, crawl.select("source_id", "content")), number, changed)
    rewritten = touched | _parts(done, states)
    states.write(committed.where(states.part_of("source_id").isin(*rewritten)) if rewritten else committed.limit(0), number, rewritten)
    report = events.join(failed.withColumn("failed", F.lit(True)), "source_id", "left").groupBy("change").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    report.withColumn("crawls_ended", F.lit(",".join(map(str, sorted(ended))))).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/log/batch={number}")
    for table in (states, pages):
        table.clean()
    for df in (failed, events, crawl, rows):
        df.unpersist()


def follow(stream: DataFrame, folder: str, checkpoint: str, fails: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start the job on a stream of crawls; ``trigger`` as for writeStream, all there is by default."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: apply_batch(batch, number, folder, fails))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def without_children(rows: DataFrame, parents: DataFrame, parent: str = "parent_url") -> DataFrame:
    """Rows whose parent (source_id) isn't among those deleted; rows without a parent stay."""
    return rows.join(parents.select(F.col("source_id").alias(parent)), parent, "left_anti").select(rows.columns)


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, file_hash) of the files that are new or whose hash isn't the known one."""
    return files.join(known.select("path", F.col("file_hash").alias("_known")), "path", "left").where(~F.col("file_hash").eqNullSafe(F.col("_known"))).drop("_known")
