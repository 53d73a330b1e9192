"""Gates that hold an answer against its question and its context, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.functions.questions import fits
from corvane.functions.text import expected_units, unit_values

UNITS = (*fixed.UNIT_PATTERNS, *fixed.UNIT_PATTERNS_AROUND)


def _found(text: Column, pattern: str) -> Column:
    """The distinct finds of a pattern, blanks around them left out."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.trim(x)))


def present_units(text: Column) -> Column:
    """Names of the units of which the text has values, sorted."""
    has = (F.when(F.size(unit_values(text, u)) > 0, F.lit(u)) for u in sorted(UNITS))
    return F.array_compact(F.array(*has))


def mismatch(question: Column, answer: Column) -> Column:
    """The first kind of sign in which the answer contradicts the question, ``subject`` last; null if none does."""
    out = F.when(_subjects_differ(question, answer), "subject")
    shared = [(n, p, lambda q, a: ~F.arrays_overlap(q, a)) for n, p in fixed.SHARED_SIGNS.items()]
    exact = [(n, p, lambda q, a: F.size(F.array_except(a, q)) > 0) for n, p in fixed.EXACT_SIGNS.items()]
    for name, pattern, against in reversed(exact + shared):
        q, a = _found(question, pattern), _found(answer, pattern)
        out = F.when((F.size(q) > 0) & (F.size(a) > 0) & against(q, a), name).otherwise(out)
    return out


def _subjects_differ(question: Column, answer: Column) -> Column:
    pairs = [(question.rlike(p), answer.rlike(p)) for p in fixed.SUBJECT_SIGNS.values()]
    asked, given, both = (reduce(or_, x) for x in ([q for q, _ in pairs], [a for _, a in pairs], [q & a for q, a in pairs]))
    return asked & given & ~both


def aligns(question: Column, answer: Column) -> Column:
    """Whether the answer has what the question asks for and contradicts none of its signs."""
    expected, present = expected_units(question), present_units(answer)
    required = F.array(*map(F.lit, fixed.REQUIRED_UNITS))
    must, may = F.array_intersect(expected, required), F.array_except(expected, required)
    units = (F.size(F.array_except(must, present)) == 0) & ((F.size(may) == 0) | (F.size(must) > 0) | F.arrays_overlap(may, present))
    return mismatch(question, answer).isNull() & ((F.size(expected) == 0) | ((F.size(present) > 0) & units))


def missing_units(question: Column, answer: Column) -> Column:
    return F.array_except(expected_units(question), present_units(answer))


def entity_lines(context: Column, entity: Column) -> Column:
    return F.filter(F.split(context, "\n"), lambda x: x.contains(entity))


def extension(lines: Column) -> Column:
    """The telephone extension of the first line that has one: of a whole number, else four digits that stand alone."""
    each = F.transform(lines, lambda x: F.coalesce(first_value(x, fixed.UNIT_PATTERNS["phone"]), first_value(x, fixed.EXTENSION)))
    return F.get(F.array_compact(each), F.lit(0))


def first_value(text: Column, pattern: str, group: int = 1) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def filled(question: Column, answer: Column, context: Column, entity: Column) -> Column:
    """The answer with a note of the units it lacks, as the context gives them; with an entity only its lines count."""
    missing, lines = missing_units(question, answer), entity_lines(context, entity)
    pool = F.when(entity.isNull(), context).when(F.size(lines) > 0, F.array_join(lines, "\n"))
    notes = []
    for unit, form in fixed.UNIT_NOTES.items():
        value = F.get(unit_values(pool, unit), F.lit(0))
        value = F.coalesce(value, extension(lines)) if unit == "phone" else value
        notes.append(F.when(F.array_contains(missing, unit) & value.isNotNull(), put(form, {"1": value})))
    added = F.array_compact(F.array(*notes))
    noted = F.concat(F.regexp_replace(answer, r"\s+$", ""), F.lit(fixed.NOTE_HEAD), F.array_join(added, fixed.NOTE_JOIN))
    return F.when((F.coalesce(context, F.lit("")) != "") & (F.size(added) > 0), noted).otherwise(answer)


def put(form: str, values: dict[str, Column]) -> Column:
    """The form with its {names} replaced."""
    parts = re.split(r"\{(\w+)\}", form)
    return F.concat(*(values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def unsupported(answer: Column, context: Column) -> Column:
    """The first value (``unit:value``) of the answer that the context lacks: addresses, sums, grades, then credits."""
    close = F.replace(context, F.lit(" "), F.lit(""))
    has = {
        "url": lambda v: context.contains(v),
        "won": lambda v: context.contains(v) | context.contains(F.replace(v, F.lit(","), F.lit(""))),
        "grade": lambda v: context.contains(v),
        "credit": lambda v: context.contains(v) | close.contains(v),
    }

    def lacking(unit: str, holds: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(unit_values(answer, unit), lambda v: ~holds(v)), lambda v: F.concat(F.lit(f"{unit}:"), v))

    return F.when((answer != "") & (context != ""), F.get(F.flatten(F.array(*(lacking(u, f) for u, f in has.items()))), F.lit(0)))


def value_count(question: Column, context: Column) -> Column:
    """Two, if the question's words or pattern, or the context's pattern, name two values; else one."""
    words = reduce(or_, (fits(question, [[w] for w in pair]) for pair in fixed.TWO_VALUE_WORDS))
    two = words | question.rlike(fixed.TWO_VALUE_PATTERN) | F.coalesce(context.rlike(fixed.TWO_VALUE_PATTERN), F.lit(False))
    return F.when((question != "") & two, 2).otherwise(1)


def complete(question: Column, answer: Column, context: Column) -> Column:
    """Whether the answer has as many credits and courses as the question asks for."""
    return (value_count(question, context) == 1) | (F.size(unit_values(answer, "credit")) + F.size(unit_values(answer, "course")) >= 2)


def fact(question: Column, context: Column, department: Column) -> Column:
    """The answer that the first fitting rule reads from the context, of a department last; null if no rule finds any."""
    asked = F.regexp_replace(F.lower(question), r"\s+", "")
    more = F.coalesce(F.concat(F.lit(" "), first_value(context, fixed.FACT_MORE)), F.lit(""))
    found = []
    for groups, none, patterns in fixed.FACT_RULES:
        for pattern, form in patterns:
            values = {str(i): first_value(context, pattern, i) for i in range(1, pattern.count("(") - pattern.count("(?:") + 1)}
            found.append(F.when(fits(asked, groups, none), put(form, values | {"more": more})))
    lines = entity_lines(context, department)
    room = F.get(F.array_compact(F.transform(lines, lambda x: first_value(x, fixed.UNIT_PATTERNS_AROUND["room"]))), F.lit(0))
    parts = F.array_compact(F.array(put(fixed.REACH_PHONE, {"1": extension(lines)}), put(fixed.REACH_ROOM, {"1": room})))
    reach = F.when(fits(asked, (fixed.REACH_WORDS,)) & (F.size(parts) > 0), F.concat(department, F.lit("의 "), F.array_join(parts, ", "), F.lit("입니다.")))
    return F.coalesce(*found, reach)


def may_stand(answer: Column, redirects: Column, raw_score: Column) -> Column:
    """Whether a row's stored answer may be given: there is one, it doesn't only refer elsewhere, and no rerank score is too low."""
    return (F.coalesce(answer, F.lit("")) != "") & ~redirects & F.coalesce(raw_score >= fixed.BYPASS_SCORE, F.lit(True))


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.length(text) * 1.5).cast("long")


def direct(rows: DataFrame, query: str, rank: str, answer: str, may: str) -> DataFrame:
    """(query, answer, rank): the answer of the first row of each query that may be given."""
    found = rows.where(F.col(may)).groupBy(query).agg(F.min_by(answer, rank).alias(answer), F.min(rank).alias(rank))
    return found.select(query, answer, rank)
