"""Analysis of English questions as Column expressions: their Korean terms (found by a dictionary) decide what is wanted, their own words the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import english_rules as rules
from corvane.functions import questions
from corvane.functions.questions import first, fits
from corvane.functions.rules import DEPARTMENTS, GRAPH_INTENTS
from corvane.functions.text import any_of


def student_year(text: Column) -> Column:
    """The year of a class or cohort, else of admission (unless later ones are meant, too), else a cohort in two digits."""
    got = lambda pattern, group=1: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    return F.coalesce(got(rules.COHORT), got(rules.COHORT, 2), got(rules.ADMITTED), F.concat(F.lit("20"), got(rules.SHORT_COHORT)))


def student_type(text: Column) -> Column:
    return first([(text.rlike(p), F.lit(name)) for name, p in rules.STUDENT_TYPES], F.lit("내국인"))


def focus(low: Column) -> Column:
    found = first([(fits(low, groups), F.lit(name)) for name, groups in rules.FOCUS_RULES])
    return F.when(~((found == "period") & any_of(low, rules.NO_PERIOD)), found)


def _named(low: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    return first([(any_of(low, words), F.lit(name)) for name, words in table])


def entities(text: Column, low: Column, terms: Column, asked: Column) -> Column:
    """A map of what the question names, ``terms`` being its Korean terms and ``asked`` its focus; entries without a value are left out."""
    certificate = first([(low.contains(w), F.lit(w.upper() if w in rules.UPPER_CERTIFICATES else w)) for w in rules.CERTIFICATES])
    option = F.when(any_of(low, rules.MAJOR_CONTEXT), first([(low.contains(w), F.lit(v)) for w, v in rules.MAJOR_OPTIONS]))
    found = {
        "graduation_cert": certificate,
        "major_method": F.coalesce(first([(low.contains(w), F.lit(v)) for w, v in rules.MAJOR_METHODS]), option),
        "department": F.get(F.filter(terms, lambda t: any_of(t, DEPARTMENTS)), F.lit(0)),
        "course_number": F.nullif(F.regexp_extract(text, rules.COURSE_NUMBER, 0), F.lit("")),
        "semester_half": _named(low, rules.HALVES),
        "liberal_arts_area": _named(low, rules.LIBERAL_ARTS),
        "question_focus": asked,
    } | {name: F.when(fits(low, *rule), F.lit("true")) for name, rule in rules.ENTITY_FLAGS.items()}
    every = F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def search_terms(low: Column, terms: Column, asked: Column, kind: Column) -> Column:
    """The Korean terms and those that what is asked, phrases and transfer students add, each once."""
    some = lambda condition, *words: F.when(condition, F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>"))
    by_focus = [some(F.coalesce(asked == k, F.lit(False)), v) for k, v in rules.FOCUS_TERMS.items()]
    by_phrase = [some(any_of(low, words), term) for words, term in rules.PHRASE_TERMS]
    return F.array_distinct(F.concat(terms, *by_focus, *by_phrase, some(kind == rules.TRANSFER, *rules.TRANSFER_TERMS)))


def analyzed(rows: DataFrame, text: str, terms: str) -> DataFrame:
    """``rows`` with the whole analysis of an English question, whose Korean terms are in ``terms`` in order (see ``terms.found_terms``):
    intent, student_id, student_type, entities, requires_graph, requires_vector, missing_info, lang, question_type, ko_query.

    Each step is a column of its own, so that later ones don't repeat its expression.
    """
    t, low, korean = F.col(text), F.col("_low"), F.col("ko_query")
    found = rows.withColumns({"_low": F.lower(t), "student_id": student_year(t), "student_type": student_type(t), "_matched": F.array_distinct(terms)})
    found = found.withColumn("_asked", focus(low))
    found = found.withColumns({"entities": entities(t, low, F.col("_matched"), F.col("_asked")), "ko_query": F.nullif(F.array_join(search_terms(low, F.col("_matched"), F.col("_asked"), F.col("student_type")), " "), F.lit(""))})
    same = any_of(low, rules.EQUIVALENTS) & low.contains(rules.RETAKE)
    found = found.withColumns({"_by_terms": F.when(korean.isNull(), "GENERAL").otherwise(questions.intent(korean)), "_same": same, "_grading": any_of(low, rules.GRADE_CHOICE) & ~same, "lang": F.lit("en"), "question_type": questions.question_type(F.coalesce(korean, t), F.lit(""))})
    found = found.withColumn("intent", F.when(F.col("_same"), "ALTERNATIVE").when(F.col("_grading"), "REGISTRATION").otherwise(F.col("_by_terms")))
    graph = F.when(F.col("_grading"), F.coalesce(F.col("_asked") == "period", F.lit(False))).otherwise(F.col("_by_terms").isin(*GRAPH_INTENTS))
    found = found.withColumns({"requires_graph": graph, "requires_vector": F.lit(True), "missing_info": questions.missing_info(F.col("intent"), F.col("student_id"))})
    return found.drop("_low", "_matched", "_asked", "_by_terms", "_same", "_grading")
