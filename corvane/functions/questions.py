"""Question analysis as Column expressions made from rule tables.

A rule asks that one word of each of its groups occur and none of its excluded words; tables of rules become one CASE
expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import rules
from corvane.functions.text import any_of

YEAR, SHORT, RANGE, BOUND = r"(20[12]\d)학번", r"(?<![\w가-힣])([12]\d)학번", r"(20[12]\d)\s*[~\-]\s*(20[12]\d)학번", r"(20[12]\d)학번\s*(이후|이전)"


def fits(text: Column, groups: Sequence[Sequence[str]], none: Sequence[str] = ()) -> Column:
    found = reduce(and_, (any_of(text, g) for g in groups))
    return found & ~any_of(text, none) if none else found


def first(cases: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = otherwise if otherwise is not None else F.lit(None)
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def intent(text: Column) -> Column:
    """The first fitting rule's intent; else the one with most words, ties by what is asked, then by the table's order; else GENERAL."""
    names = list(rules.INTENT_WORDS)
    counts = F.array(*(sum((text.contains(w).cast("int") for w in words), F.lit(0)) for words in rules.INTENT_WORDS.values()))
    asked = F.struct(*(any_of(text, words).alias(name) for name, words in (("period", rules.PERIOD), ("limit", rules.LIMIT), ("method", rules.METHOD))))

    def most(s: Column) -> Column:
        leads = lambda name: F.get(s["scores"], F.lit(names.index(name))) == s["best"]
        tied = F.size(F.filter(s["scores"], lambda x: x == s["best"])) > 1
        ties = [("period", "SCHEDULE"), ("limit", "REGISTRATION"), ("limit", "GRADUATION_REQ"), ("method", "LEAVE_OF_ABSENCE")]
        return first([(s["best"] == 0, F.lit("GENERAL")), *((tied & s["asked"][a] & leads(name), F.lit(name)) for a, name in ties)], F.element_at(F.array(*map(F.lit, names)), F.array_position(s["scores"], s["best"]).cast("int")))

    scored = bound(counts, lambda c: F.struct(c.alias("scores"), F.array_max(c).alias("best"), asked.alias("asked")))
    by_rule = [(fits(text, groups, none), F.lit(name)) for name, groups, none in rules.INTENT_RULES]
    return first(by_rule, bound(scored, most))


def focus(text: Column) -> Column:
    return first([(fits(text, groups), F.lit(name)) for name, groups in rules.FOCUS_RULES])


def entities(text: Column) -> Column:
    """A map of what the question names; entries without a value are left out."""
    words = lambda table: first([(any_of(text, ws), F.lit(name)) for name, ws in table])
    found = {
        "department": department(text),
        "course_number": F.nullif(F.regexp_extract(text, r"[A-Z]{2,4}\d{3,4}", 0), F.lit("")),
        "course_name": course_name(text),
        "liberal_arts_area": words(rules.LIBERAL_ARTS),
        "major_method": F.when(text.rlike(r"방법\s*[123]"), F.concat(F.lit("방법"), F.regexp_extract(text, r"방법\s*([123])", 1))),
        "graduation_cert": F.when(F.lower(text).contains("topik"), F.lit("TOPIK")),
        "question_focus": focus(text),
        "semester_half": words((("전기", ("전기",)), ("후기", ("후기",)))),
    } | {name: F.when(fits(text, *rule), F.lit("true")) for name, rule in rules.ENTITY_FLAGS.items()}
    every = F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def department(text: Column) -> Column:
    """The first department of the table that the question names."""
    return first([(text.contains(d), F.lit(d)) for d in rules.DEPARTMENTS], F.lit(None).cast("string"))


def course_name(text: Column) -> Column:
    """The word before one for equivalents of a course, else before one for a course, unless it names none."""
    named = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (rules.COURSE_BEFORE, rules.COURSE_WITHIN)]
    return F.coalesce(*(F.when(~n.isin(*rules.NOT_COURSES), n) for n in named))


def stores(text: Column, intent_: Column) -> Column:
    """(graph, vector): whether a question is asked of the graph, and of texts."""
    timetable = (intent_ == "SCHEDULE") & ~any_of(text, rules.SCHEDULE_TEXT_WORDS)
    online = F.lower(text).contains("ocu") & any_of(text, rules.OCU_TEXT_WORDS)
    only, both = any_of(text, rules.TEXT_ONLY_WORDS), any_of(text, rules.BOTH_WORDS)
    graph = F.when(both, True).when(only, False).otherwise(intent_.isin(*rules.GRAPH_INTENTS))
    return F.struct(graph.alias("graph"), (both | only | online | ~timetable).alias("vector"))


def missing_info(intent_: Column, year: Column) -> Column:
    """What has to be asked for: the year of entry, for some intents."""
    return F.when(year.isNull() & intent_.isin(*rules.YEAR_INTENTS), F.array(F.lit("student_id"))).otherwise(F.array().cast("array<string>"))


def analyzed(rows: DataFrame, text: str, group_of) -> DataFrame:
    """``rows`` with the whole analysis of a Korean question in formal terms (see ``terms.replaced_terms``): intent, student_id,
    student_type, entities, requires_graph, requires_vector, missing_info, lang, question_type, ko_query."""
    t = F.col(text)
    found = rows.withColumns({"intent": intent(t), "student_id": student_year(t), "student_type": student_type(t), "_named": entities(t), "_groups": F.array_join(student_groups(t, group_of), ",")})
    found = found.withColumns({"_stores": stores(t, F.col("intent")), "entities": F.when(F.col("_groups") != "", F.map_concat("_named", F.create_map(F.lit("student_groups"), "_groups"))).otherwise(F.col("_named"))})
    return found.withColumns(
        {
            "requires_graph": F.col("_stores.graph"),
            "requires_vector": F.col("_stores.vector"),
            "missing_info": missing_info(F.col("intent"), F.col("student_id")),
            "lang": F.lit("ko"),
            "question_type": question_type(t, F.coalesce(F.col("_named")["question_focus"], F.lit(""))),
            "ko_query": F.lit(None).cast("string"),
        }
    ).drop("_named", "_groups", "_stores")


def student_groups(text: Column, group_of) -> Column:
    """Distinct groups in the order: a range's two ends (2024 to 2025: one group of its own), years with a bound, years, two-digit years."""
    none = F.array().cast("array<string>")
    start, end = F.regexp_extract(text, RANGE, 1), F.regexp_extract(text, RANGE, 2)
    of_range = F.when(~text.rlike(RANGE), none).when((start == "2024") & (end == "2025"), F.array(F.lit("2024_2025"))).otherwise(F.array(group_of(start), group_of(end)))
    bounds = F.transform(F.regexp_extract_all(text, F.lit(BOUND), F.lit(0)), lambda m: F.when(m.endswith("이전"), F.substring(m, 1, 4)).otherwise(group_of(F.substring(m, 1, 4))))
    years = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), group_of)
    short = F.transform(F.regexp_extract_all(text, F.lit(SHORT), F.lit(1)), lambda m: group_of(F.concat(F.lit("20"), m)))
    return F.array_distinct(F.concat(of_range, bounds, years, short))


def student_year(text: Column) -> Column:
    """The first year of entry named in full, else in two digits, else the range's start."""
    got = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(got(YEAR), F.concat(F.lit("20"), got(SHORT)), got(RANGE))


def student_type(text: Column) -> Column:
    return first([(any_of(text, ws), F.lit(name)) for name, ws in rules.STUDENT_TYPES], F.lit("내국인"))


def question_type(text: Column, asked: Column | None = None) -> Column:
    """overview for short topics, reasoning for conditions, else by what is asked; what no rule settles is left to vectors, or a factoid."""
    asks = any_of(text, rules.QUESTION_WORDS)
    short = (F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) <= 4) | (F.length(text) <= 8)
    kinds = F.create_map(*(F.lit(x) for pair in rules.FOCUS_TYPES.items() for x in pair))
    focused = F.try_element_at(kinds, F.coalesce(asked if asked is not None else focus(text), F.lit("")))
    return first([(short & ~asks, F.lit("overview")), (any_of(text, rules.CONDITIONAL) & asks, F.lit("reasoning"))], F.coalesce(focused, F.lit("factoid")))


def follow_up(text: Column, has_history: Column) -> Column:
    """(is_follow_up, skip_rules, reason): whether a question leans on earlier turns, and whether a pronoun can't be put in by rule."""
    q = F.trim(text)
    low = F.concat(F.lit(" "), F.lower(q), F.lit(" "))
    either = lambda ko, en: any_of(q, ko) | any_of(low, en)
    named = lambda ko, en: first([*((q.contains(w), F.lit(w.strip())) for w in ko), *((low.contains(w), F.lit(w.strip())) for w in en)])
    words = F.size(F.regexp_extract_all(q, F.lit(r"\S+"), F.lit(0)))
    each, compared = either(rules.DISTRIBUTIVE, rules.DISTRIBUTIVE_EN), either(rules.COMPARISON, rules.COMPARISON_EN)
    single, elliptic = (named(*x) for x in ((rules.SINGULAR, rules.SINGULAR_EN), (rules.ELLIPTIC, rules.ELLIPTIC_EN)))
    denied = named(rules.NEGATION, ())
    few = rules.FEW_WORDS
    subject = q.rlike(r"[가-힣A-Za-z0-9]{2,}(은|는|이|가|께서)\s")
    said = lambda yes, skip, reason: F.struct(F.lit(yes).alias("is_follow_up"), F.lit(skip).alias("skip_rules"), reason.alias("reason"))
    return first(
        [
            (F.coalesce(q, F.lit("")) == "", said(False, False, F.lit("empty_query"))),
            (~has_history, said(False, False, F.lit("no_history"))),
            (each & compared, said(True, True, F.lit("distributive+comparison"))),
            (single.isNotNull(), said(True, False, F.concat(F.lit("singular_pronoun:"), single))),
            (each, said(True, True, F.lit("distributive_only"))),
            (compared & (words <= 2 * few), said(True, True, F.lit("comparison_only"))),
            (elliptic.isNotNull() & (words <= few), said(True, True, F.concat(F.lit("elliptic_short:"), elliptic))),
            (denied.isNotNull() & (words <= 2 * few), said(True, True, F.concat(F.lit("negation_short:"), denied))),
            ((words <= few) & ~subject & q.rlike("[가-힣]"), said(True, True, F.lit("no_subject_short_ko"))),
        ],
        said(False, False, F.lit("not_follow_up")),
    )


def node_types(intent_: Column, department_: Column, low: Column) -> Column:
    """Distinct node types of the intent's communities, then of those that a department and words of the question (in lower case) add."""
    strings = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    of_intent = first([(intent_ == k, strings(v)) for k, v in rules.INTENT_COMMUNITIES.items()], strings(()))
    added = [F.when(department_.isNotNull(), strings(("curriculum",))).otherwise(strings(()))] + [F.when(any_of(low, ws), strings((c,))).otherwise(strings(())) for c, ws in rules.COMMUNITY_WORDS]
    chosen = F.array_distinct(F.concat(of_intent, *added))
    members = F.create_map(*(x for k, v in rules.COMMUNITIES.items() for x in (F.lit(k), strings(v))))
    return F.array_distinct(F.flatten(F.transform(chosen, lambda c: F.try_element_at(members, c))))


def search_text(text: Column, language: Column, korean: Column, intent_: Column, asks_url: Column) -> Column:
    """English questions search by their Korean terms, alone if these have seven characters; a timetable's site is asked for by name."""
    asked = F.when(asks_url & (intent_ == "COURSE_INFO") & text.contains("시간표"), F.concat(text, F.lit(" 수강신청 사이트"))).otherwise(text)
    has = (language == "en") & (F.coalesce(korean, F.lit("")) != "")
    return F.when(has & (F.length(korean) >= 7), korean).when(has, F.concat_ws(" ", korean, asked)).otherwise(asked)
