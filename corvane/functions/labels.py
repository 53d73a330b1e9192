"""Masks, keys and printed forms of names, ids and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Student ids and names beside the word for student, and what stands in their place.
ID_IN_PROMPT, ID_IN_LOG, LOG_MARK = r"((?:19|20)[0-9]{2})[0-9]{4,5}", r"(?:19|20)[0-9]{5,7}", "[REDACTED_ID]"
NAME_BESIDE, NAME_MARK = r"(?<=[^가-힣])[가-힣]{2,4}(?= ?학생)", "해당"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
KEY_LENGTH = 40


def for_prompt(text: Column) -> Column:
    """Student ids keep their year, names before the word for student go."""
    return F.regexp_replace(F.regexp_replace(text, ID_IN_PROMPT, "$1학번"), NAME_BESIDE, NAME_MARK)


def for_log(text: Column) -> Column:
    return F.regexp_replace(text, ID_IN_LOG, LOG_MARK)


def masked_name(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "").otherwise(F.concat(F.substring(name, 1, 1), F.repeat(F.lit("○"), F.greatest(F.lit(1), F.length(name) - 1))))


def node_key(title: Column) -> Column:
    """Letters, digits and underscores of the title without its brackets; of titles without any a hash."""
    key = F.regexp_replace(F.regexp_replace(title, r"\([^\n]*?\)", ""), r"[\s·\-/,.]+", "_")
    key = F.substring(F.regexp_replace(F.regexp_replace(key, r"[^\p{L}\p{N}_]", ""), "^_+|_+$", ""), 1, KEY_LENGTH)
    return F.when(key == "", F.substring(F.md5(title), 1, 8)).otherwise(key)


def file_name(path: Column) -> Column:
    last = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(last == "", path).otherwise(last)


def printed_date(day: Column, language: str) -> Column:
    """A day (yyyy-mm-dd) in words; other texts stay."""
    y, m, d = (F.regexp_extract(day, r"^(\d{4})-(\d{2})-(\d{2})", i).try_cast("int") for i in (1, 2, 3))
    names = F.array(*map(F.lit, MONTHS))
    words = F.concat(F.get(names, m - 1), F.lit(" "), d, F.lit(", "), y) if language == "en" else F.concat(y, F.lit("년 "), m, F.lit("월 "), d, F.lit("일"))
    return F.coalesce(words, day, F.lit(""))


def printed_period(start: Column, end: Column, language: str) -> Column:
    """The year stands at the start only."""
    m, d = (F.substring(end, at, 2).try_cast("int") for at in (6, 9))
    first, whole = printed_date(start, language), end.rlike(r"^.{4}-.{2}-..")
    if language == "en":
        late = F.when(whole, F.concat(F.get(F.array(*map(F.lit, MONTHS)), m - 1), F.lit(" "), d)).otherwise(end)
        both = F.concat(first, F.lit(" to "), late)
    else:
        both = F.concat(first, F.lit("부터 "), F.when(whole, F.concat(m, F.lit("월 "), d, F.lit("일"))).otherwise(end), F.lit("까지"))
    return F.when(F.coalesce(start, F.lit("")) == "", "").when((F.coalesce(end, F.lit("")) == "") | (start == end), first).otherwise(both)


def calendar_range(cell: Column, year: Column, month: Column) -> tuple[Column, Column]:
    """First and last day (yyyy-mm-dd) of a calendar cell: days or month/day, parted by a tilde; vague cells have none.

    A last month before the first one is next year's.
    """
    vague = cell.rlike("[초중말]")
    parts = F.split(cell, r"\s*~\s*")

    def day(part: Column) -> tuple[Column, Column]:
        m, d = (F.regexp_extract(part, r"^(\d{1,2})/(\d{1,2})", i).try_cast("int") for i in (1, 2))
        return F.coalesce(m, month), F.coalesce(d, F.regexp_extract(part, r"^\s*(\d{1,2})", 1).try_cast("int"))

    (m1, d1), (m2, d2) = day(F.get(parts, F.lit(0))), day(F.get(parts, F.lit(1)))
    known = ~vague & d1.isNotNull()
    form = lambda y, m, d: F.concat(y.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(known, form(year, m1, d1)), F.when(known & d2.isNotNull(), form(F.when(m2 < m1, year + 1).otherwise(year), m2, d2))
