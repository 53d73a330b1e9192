"""Course-record analytics over rows (student, course, term, credits, grade)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import fixed


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def by_term(courses: DataFrame, *who: str, digits: int = 2) -> DataFrame:
    """Credits, courses and credit-weighted grade average of each term; the average is null without grades that count."""
    point = F.when(F.col("credits") > 0, _lookup(fixed.GRADE_POINTS, F.col("grade")))
    graded = F.sum(F.when(point.isNotNull(), F.col("credits")))
    rows = courses.where("term IS NOT NULL AND term != ''")
    return rows.groupBy(*who, "term").agg(F.round(F.sum("credits"), 1).alias("credits"), F.count("*").alias("courses"), F.round(F.sum(point * F.col("credits")) / graded, digits).alias("gpa"))


def grades(courses: DataFrame, *who: str) -> DataFrame:
    return courses.where("grade IS NOT NULL AND grade != ''").groupBy(*who, F.regexp_replace("grade", "^([A-D])0$", "$1").alias("grade")).agg(F.count("*").alias("n"))


def latest_term(courses: DataFrame, who: str) -> DataFrame:
    last = F.max(F.when(F.col("term") != "", F.col("term"))).over(Window.partitionBy(who))
    return courses.withColumn("_last", last).where("term = _last").drop("_last")


def retakes(courses: DataFrame, who: str, threshold: str = "B0") -> DataFrame:
    """Graded courses no better than ``threshold``, pass/fail ones left out, worst first within a student."""
    rank = _lookup(fixed.GRADE_RANKS, F.col("grade"))
    low = courses.withColumn("grade_rank", rank).where((F.col("grade_rank") >= 0) & (F.col("grade_rank") <= fixed.GRADE_RANKS.get(threshold, 7)))
    return low.withColumn("place", F.row_number().over(Window.partitionBy(who).orderBy("grade_rank", "course")))


def gaps(categories: DataFrame) -> DataFrame:
    """(student, category, required, acquired) with what is short, whether it is met, and the progress in percent."""
    short = F.greatest(F.lit(0.0), F.col("required") - F.col("acquired"))
    progress = F.when(F.col("required") > 0, F.least(F.lit(100), F.floor(F.col("acquired") / F.col("required") * 100))).otherwise(0)
    return categories.withColumn("short", F.round(short, 6)).withColumn("met", F.col("acquired") >= F.col("required")).withColumn("progress", progress.cast("long"))


def projection(totals: DataFrame, per_term: Column | int = 18) -> DataFrame:
    """Terms still needed for what is short."""
    return totals.withColumn("terms_left", F.ceil(F.greatest(F.lit(0.0), F.col("short")) / per_term).cast("long"))


def record_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(course, term, change, old_grade, new_grade): courses that came, and grades that changed to something."""
    both = old.select("course", "term", F.col("grade").alias("old_grade"), F.lit(True).alias("_old")).join(new.select("course", "term", F.col("grade").alias("new_grade"), F.lit(True).alias("_new")), ["course", "term"], "full")
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new") & (F.coalesce("new_grade", F.lit("")) != "") & ~F.col("new_grade").eqNullSafe(F.col("old_grade")), "grade")
    return both.withColumn("change", kind).where("change IS NOT NULL").select("course", "term", "change", "old_grade", "new_grade")


def actions(summaries: DataFrame, key: str, rules: Mapping[str, tuple[str, Column, Column]]) -> DataFrame:
    """(key, rule, severity, value, place): a row for each rule that holds, errors first, then warnings and notes.

    rules: by name the severity, the condition over a student's summary row, and the measure to report.
    """
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.coalesce(w, F.lit(False)).alias("holds"), v.cast("double").alias("value")) for n, (s, w, v) in sorted(rules.items())))
    rows = summaries.select(key, F.explode(each).alias("r")).where("r.holds")
    order = F.when(F.col("r.severity") == "error", 0).when(F.col("r.severity") == "warn", 1).otherwise(2)
    return rows.select(key, "r.rule", "r.severity", F.round("r.value", 6).alias("value"), F.row_number().over(Window.partitionBy(key).orderBy(order, "r.rule")).alias("place"))
