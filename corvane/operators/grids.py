"""Sheets as cells (sheet, row, col, value): fields by the marks beside or above their values, and two-column course lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.questions import first
from corvane.functions.text import student_group

#: Rows in which a profile stands, and how far to the right of its mark a value may be.
PROFILE_ROWS, REACH = 10, 5
# Marks of a profile's fields, in the order in which they are tried.
MARKS = (
    ("학부(과)", "학부과"), ("학부과", "학부과"), ("학년", "학년"), ("학번", "학번"), ("부전공", "부전공"), ("복수(융합)전공", "복수전공"), ("복수전공", "복수전공"), ("학생설계복수전공", "학생설계복수전공"),
    ("내외국인구분", "내외국인"), ("학적상태", "학적상태"), ("전공", "전공"), ("이수학기", "이수학기"), ("성명", "성명"), ("융합모듈", "융합모듈"), ("마이크로전공", "융합모듈"), ("교직", "교직"),
)
#: Fields of which the last value counts; of others, the first that isn't empty.
LAST = ("학번", "학년", "이수학기", "내외국인")
NUMBERS = ("학년", "이수학기")


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\s+", "")


def _cleaned(value: Column) -> Column:
    return F.substring(F.regexp_replace(F.replace(F.replace(F.trim(value), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")), r"(?U)\s{2,}", " "), 1, 500)


def _is_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("double") == 0.0, F.lit(False))


def marked_fields(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, field, value): the marks of the first rows with their values.

    A mark's value is the next cell of its row that isn't empty, if it is no more than five columns away and no mark itself; else the cell
    below the mark, unless that is empty or zero. Cells meet their neighbours by one window over a row and one join with the row below.
    """
    used = cells.where((F.col("row") < PROFILE_ROWS) & (F.coalesce("value", F.lit("")) != ""))
    along = Window.partitionBy("sheet", "row").orderBy("col")
    plain = _plain(F.col("value"))
    rows = used.withColumns({"plain": plain, "next_col": F.lead("col").over(along), "next": F.lead("value").over(along)})
    by_mark = first([((F.col("plain") == m) | (F.col("plain").contains(m) & (F.length("plain") < len(m) + 10)), F.lit(field)) for m, field in MARKS])
    marks = rows.withColumn("field", by_mark).where("field IS NOT NULL")
    beside = F.when((F.col("next_col") - F.col("col") <= REACH) & ~_plain(F.col("next")).isin([m for m, _ in MARKS]), _cleaned(F.col("next")))
    below = used.select("sheet", (F.col("row") - 1).alias("row"), "col", F.when(~_is_zero(F.col("value")), _cleaned(F.col("value"))).alias("below"))
    found = marks.withColumn("beside", beside).join(below, ["sheet", "row", "col"], "left")
    value = F.coalesce(F.nullif("beside", F.lit("")), F.nullif("below", F.lit("")))
    return found.select("sheet", "row", "col", "field", value.alias("value")).where("value IS NOT NULL")


def profiles(cells: DataFrame) -> DataFrame:
    """(sheet, fields, entry_year, student_type, student_group): one row for each sheet with any field; fields: a map.

    Numbers (the year and the terms of study, the student's number) are whole ones; what isn't a number is 0.
    """
    place = F.struct("row", "col")
    each = marked_fields(cells).groupBy("sheet", "field").agg(F.max_by("value", place).alias("last"), F.min_by("value", place).alias("first"))
    whole = lambda x: F.coalesce(x.try_cast("double").cast("long"), F.lit(0)).cast("string")
    last = F.col("last")
    value = F.when(F.col("field").isin(*NUMBERS), whole(last)).when((F.col("field") == "학번") & last.rlike(r"^\d+\.\d+$"), whole(last)).when(F.col("field").isin(*LAST), last).otherwise(F.col("first"))
    fields = each.select("sheet", "field", value.alias("value")).groupBy("sheet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    named = lambda n: F.try_element_at("fields", F.lit(n))
    nation = named("내외국인")
    kind = F.when(nation.contains("외국인") | nation.contains("유학생"), "외국인").when(nation.contains("편입"), "편입생").otherwise("내국인")
    year = F.when(F.length(named("학번")) >= 4, F.substring(named("학번"), 1, 4))
    # "내외국인" in a home student's cell would count as foreign, too; as results must agree, it does
    return fields.select("sheet", "fields", year.alias("entry_year"), kind.alias("student_type"), F.when(year.isNotNull(), student_group(year)).alias("student_group"))


def two_column_rows(cells: DataFrame, heads: tuple[str, ...]) -> DataFrame:
    """(sheet, block, row, values): rows of lists that stand side by side. Each row that has all of ``heads`` (in this order, from some column on)
    begins lists there, which end with a row whose first cell is empty or before the next row of heads."""
    used = cells.where(F.coalesce("value", F.lit("")) != "").select("sheet", "row", "col", _cleaned(F.col("value")).alias("value"))
    starts = used.where(_plain(F.col("value")) == heads[0]).select("sheet", F.col("row").alias("head_row"), F.col("col").alias("block"))
    for i, name in enumerate(heads[1:], 1):
        beside = used.where(_plain(F.col("value")) == name).select("sheet", F.col("row").alias("head_row"), (F.col("col") - i).alias("block"))
        starts = starts.join(beside, ["sheet", "head_row", "block"], "left_semi")
    wide = Window.partitionBy("sheet", "block").orderBy("head_row")
    starts = starts.withColumn("until", F.lead("head_row").over(wide))
    parts = used.join(starts, "sheet").where((F.col("row") > F.col("head_row")) & (F.col("until").isNull() | (F.col("row") < F.col("until"))) & F.col("col").between(F.col("block"), F.col("block") + len(heads) - 1))
    lines = parts.groupBy("sheet", "block", "head_row", "row").agg(F.map_from_entries(F.collect_list(F.struct((F.col("col") - F.col("block")).cast("int").alias("i"), "value"))).alias("m")).where(F.try_element_at("m", F.lit(0)).isNotNull())
    # a list goes on as long as its rows follow one another
    run = Window.partitionBy("sheet", "block", "head_row").orderBy("row")
    lines = lines.where("row > head_row").withColumn("_n", F.row_number().over(run)).where(F.col("row") - F.col("head_row") == F.col("_n"))
    return lines.select("sheet", "block", "row", F.array(*(F.try_element_at("m", F.lit(i)) for i in range(len(heads)))).alias("values"))
