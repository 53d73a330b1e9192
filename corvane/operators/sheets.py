"""Rows of tables and headers of pages: cells carried on, types of columns, paths of sections, groups of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that make one text.
GROUP_ROWS = 8


def carried(rows: DataFrame, sheet: str, pos: str, fields: Sequence[str], others: Sequence[str]) -> DataFrame:
    """``rows`` without blank ones; an empty cell of ``fields`` has the last value above it in its sheet."""
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    above = Window.partitionBy(sheet).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.where(F.coalesce(*map(some, [*fields, *others])).isNotNull())
    return kept.withColumns({c: F.last(some(c), ignorenulls=True).over(above) for c in fields})


def column_types(cells: DataFrame, *column: str) -> DataFrame:
    """(column, n, kind) of (column, value): dates if more than half look so, credits above 0.3, numbers above half, else text."""
    share = lambda p: F.avg(F.col("value").rlike(p).cast("int"))
    found = cells.groupBy(*column).agg(F.count("*").alias("n"), share(r"\d{1,4}[.\-/]\d{1,2}[.\-/]\d{1,2}").alias("dates"), share(r"\d+\s*학점").alias("credits"), share(r"^\s*\d+(\.\d+)?\s*$").alias("numbers"))
    kind = F.when(F.col("dates") > 0.5, "date").when(F.col("credits") > 0.3, "credit").when(F.col("numbers") > 0.5, "number").otherwise("text")
    return found.select(*column, "n", kind.alias("kind"))


def section_paths(headers: DataFrame, page: str, pos: str, levels: int = 6) -> DataFrame:
    """``headers`` (page, pos, level, title) with ``path`` and ``depth``: a header ends those of its level and below. Positions differ within a page."""
    above = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    level, titles = F.col("level"), []
    for i in range(1, levels + 1):
        last, ended = F.max(F.when(level == i, F.col(pos))).over(above), F.max(F.when(level < i, F.col(pos))).over(above)
        title = F.last(F.when(level == i, F.col("title")), ignorenulls=True).over(above)
        titles.append(F.when(last > F.coalesce(ended, last - 1), title))
    open_ = F.array_compact(F.array(*titles))
    return headers.withColumn("_open", open_).withColumn("path", F.array_join("_open", " > ")).withColumn("depth", F.size("_open")).drop("_open")


def row_groups(rows: DataFrame, keys: Sequence[str], order: str, text: Column, most: int = GROUP_ROWS) -> DataFrame:
    """(keys, part, text): the rows of a key in order, ``most`` to a text, a line each."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    parts = rows.withColumn("_text", text).withColumn("_nth", nth).withColumn("part", F.floor((F.col("_nth") - 1) / most).cast("int"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_text"))), lambda x: x["_text"])
    return parts.groupBy(*keys, "part").agg(F.array_join(lines, "\n").alias("text"))


def heading_levels(letters: DataFrame, key: str = "doc", size: str = "size", apart: float = 1.5, gap: float = 0.7) -> DataFrame:
    """(key, size, level): the sizes of a document's letters that are headings, by tenths of a point.

    Text has the commonest size (the smallest of equally common ones). Sizes that are larger by at least ``apart`` are headings;
    from the largest on, a new level begins where the next smaller size is more than ``gap`` away.
    """
    tenths = letters.select(key, F.round(F.col(size) * 10).cast("long").alias("t")).where("t IS NOT NULL").groupBy(key, "t").agg(F.count("*").alias("n"))
    body = tenths.groupBy(key).agg(F.max_by("t", F.struct("n", -F.col("t"))).alias("body"))
    large = tenths.join(body, key).where(F.col("t") >= F.col("body") + round(apart * 10))
    down = Window.partitionBy(key).orderBy(F.desc("t"))  # the different sizes of one document
    fresh = F.coalesce((F.lag("t").over(down) - F.col("t") > round(gap * 10)).cast("int"), F.lit(1))
    levels = large.withColumn("_fresh", fresh).withColumn("level", F.sum("_fresh").over(down))
    return levels.select(key, (F.col("t") / 10).alias(size), "level")
