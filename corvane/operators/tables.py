"""Upserts, deletes, snapshot differences and duplicate handling over plain tables.

Without a table format, a change is a new version of the table: what stays (an anti-join on the key) and what comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in ``order``."""
    keys = [key] if isinstance(key, str) else key
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Old rows, and new ones whose key isn't there."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def delete_by_source(rows: DataFrame, source: str, file: str = "source_file", url: str = "source_url") -> DataFrame:
    """Without the rows of a source file; if there are none, without those of the URL."""
    flagged = rows.crossJoin(F.broadcast(rows.agg(F.coalesce(F.max(F.col(file) == source), F.lit(False)).alias("_file"))))
    gone = F.when(F.col("_file"), F.col(file) == source).otherwise(F.col(url) == source)
    return flagged.where(~F.coalesce(gone, F.lit(False))).drop("_file")


def changes(old: DataFrame, new: DataFrame, assume_complete: bool = False) -> DataFrame:
    """(source_id, change, old_hash, new_hash) between snapshots (source_id, content_hash).

    An id that is gone counts as deleted only if the new snapshot has ids of its scheme (or it has none);
    ``assume_complete`` drops that condition.
    """
    scheme = F.when(F.col("source_id").contains("://"), F.regexp_extract("source_id", "^(.*?)://", 1))
    both = old.select("source_id", F.col("content_hash").alias("old_hash")).join(new.select("source_id", F.col("content_hash").alias("new_hash")), "source_id", "full")
    kind = F.when(F.col("old_hash").isNull(), "NEW").when(F.col("new_hash").isNull(), "DELETED").when(F.col("old_hash") != F.col("new_hash"), "MODIFIED")
    found = both.withColumn("change", kind).where("change IS NOT NULL").withColumn("scheme", scheme)
    schemes = new.select(scheme.alias("scheme")).where("scheme IS NOT NULL").distinct().withColumn("crawled", F.lit(True))
    checked = found.join(schemes, "scheme", "left")
    if not assume_complete:
        checked = checked.where((F.col("change") != "DELETED") | F.col("scheme").isNull() | F.col("crawled"))
    return checked.select("source_id", "change", "old_hash", "new_hash")


def apply_changes(table: DataFrame, events: DataFrame, content: DataFrame) -> DataFrame:
    """The table (source_id, ...) after the events; ``content`` has the rows of new and modified ids."""
    touched = events.select("source_id")
    fresh = content.join(events.where("change != 'DELETED'").select("source_id"), "source_id", "left_semi")
    return table.join(touched, "source_id", "left_anti").unionByName(fresh)


def commit_state(state: DataFrame, events: DataFrame, failed: DataFrame, at: Column) -> DataFrame:
    """State (source_id, content_hash, first_seen, last_seen) after the events that didn't fail; first_seen stays."""
    done = events.join(failed.select("source_id"), "source_id", "left_anti")
    merged = state.join(done.select("source_id", "change", "new_hash"), "source_id", "full")
    return merged.where("change IS NULL OR change != 'DELETED'").select(
        "source_id", F.coalesce("new_hash", "content_hash").alias("content_hash"), F.coalesce("first_seen", at).alias("first_seen"), F.when(F.col("change").isNotNull(), at).otherwise(F.col("last_seen")).alias("last_seen")
    )


def pivot_entries(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, meta): key/value rows (key, name, value) gathered into a map, the last value by name order winning."""
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("meta"))


def field_report(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """(node_type, field, kind): attribute names that the registry (node_type, field, required) lacks, and required ones that nodes lack."""
    fields = nodes.select("node_type", "node_id", F.explode(F.map_keys("attrs")).alias("field"))
    unseen = fields.select("node_type", "field").distinct().join(registry, ["node_type", "field"], "left_anti").withColumn("kind", F.lit("unseen"))
    need = nodes.join(registry.where("required"), "node_type").select("node_type", "node_id", "field")
    missing = need.join(fields, ["node_type", "node_id", "field"], "left_anti").select("node_type", "field").distinct().withColumn("kind", F.lit("missing"))
    return unseen.unionByName(missing)


def delete_by_type(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Without the rows of a type; rows without a type stay."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(value)))


def islands(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first_value, last_value, periods): runs of consecutive whole numbers, repeats counted once."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(value))
    runs = rows.select(key, value).distinct().withColumn("_run", F.col(value) - place)
    return runs.groupBy(key, "_run").agg(F.min(value).alias("first_value"), F.max(value).alias("last_value"), F.count("*").alias("periods")).drop("_run")


def next_ids(ids: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """(day, next_id): the id after the largest of each day, for ids like faq-20240131-0007."""
    parts = ids.select(F.regexp_extract(column, r"^(.*)-(\d{8})-(\d+)$", 1).alias("prefix"), F.regexp_extract(column, r"-(\d{8})-\d+$", 1).alias("day"), F.regexp_extract(column, r"(\d+)$", 1).cast("long").alias("n"))
    last = parts.where("day != ''").groupBy("prefix", "day").agg(F.max("n").alias("n"))
    return last.select("day", F.concat_ws("-", "prefix", "day", F.lpad((F.col("n") + 1).cast("string"), digits, "0")).alias("next_id"))


def source_urls(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(query_id, url, rank): the distinct web addresses of rows of the types, by the first row that has them."""
    web = rows.where(F.col("doc_type").isin(*types) & (F.col("url").startswith("http://") | F.col("url").startswith("https://")))
    return web.groupBy("query_id", "url").agg(F.min("rank").alias("rank"))
