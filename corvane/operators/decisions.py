"""Decision tables over a property graph: ordered rules with guards, lookups by built ids, answer templates and gates.

A table is compiled to one plan for all questions: each lookup is one join, whatever the number of rules that read it;
guards and templates are expressions over the question and the attributes found; only nodes that are told as they are
are joined once more, by the ids that the chosen rules built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.questions import first
from corvane.functions.text import any_of, normalized

Words = tuple[str, ...]
REF = re.compile(r"\{([^{}]+)\}")


@dataclass(frozen=True)
class Rule:
    """text, norm: groups of words, of each of which the question (or its normalised form) has one; not_text, not_norm: words that it has
    none of. named, unnamed: entities it names or doesn't. flags, unflagged: boolean columns of the question. needs: references that have a value.
    answer, context: parts that are put together (answers by a blank), each left out if one of its references has no value. A rule without an answer
    may tell a node (its id as a template) instead."""

    name: str
    score: float
    text: tuple[Words, ...] = ()
    norm: tuple[Words, ...] = ()
    not_text: Words = ()
    not_norm: Words = ()
    named: Words = ()
    unnamed: Words = ()
    flags: Words = ()
    unflagged: Words = ()
    needs: Words = ()
    answer: Words = ()
    context: Words = ()
    node: str = ""


@dataclass(frozen=True)
class Lookup:
    """A node by its id (a template over the question's columns), or the least neighbour of a type of another lookup's node."""

    key: str = ""
    of: str = ""
    node_type: str = ""


@dataclass(frozen=True)
class Handler:
    """One intent's rules: of ``first`` only the first that fits is told; if none does, all that fit of ``rest``. gate: references
    without which nothing is told. every: if nothing else is, all nodes of this type with this score (by id, so many at most)."""

    intent: str
    first: tuple[Rule, ...] = ()
    rest: tuple[Rule, ...] = ()
    gate: Words = ()
    every: tuple[str, float, int] | None = None


def korean_date(day: Column) -> Column:
    part = lambda i: F.regexp_extract(day, r"^(\d{4})-(\d{2})-(\d{2})", i).try_cast("int")
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat(part(1), F.lit("년 "), part(2), F.lit("월 "), part(3), F.lit("일"))).otherwise(day)


def _value(ref: str) -> Column:
    """A question's column, an attribute (lookup.name) or the node's id (lookup.node_id), its date or hour (lookup.name|date), the
    word for what has ended if it says so (lookup.name|ended), or a period (lookup.from~to)."""
    if "~" in ref:
        look, ends = ref.split(".", 1)
        start, end = (_value(f"{look}.{x}") for x in ends.split("~"))
        short = F.regexp_extract(korean_date(end), r"(\d+월 \d+일)$", 1)
        return F.when(end.isNull() | (start == end), korean_date(start)).otherwise(F.concat(korean_date(start), F.lit("부터 "), short, F.lit("까지")))
    ref, _, form = ref.partition("|")
    if "." not in ref:
        return F.col(ref).cast("string")
    look, name = ref.split(".", 1)
    if name == "node_id":
        return F.col(f"_{look}.node_id")
    value = F.nullif(F.try_element_at(F.col(f"_{look}.attrs"), F.lit(name)), F.lit(""))
    ended = F.when(value.contains("불가") | value.contains("폐지"), "폐지")
    return {"": value, "ended": ended, "date": korean_date(F.substring_index(value, " ", 1)), "hour": F.nullif(F.substring(F.get(F.split(value, " "), F.lit(1)), 1, 2), F.lit(""))}[form]


def _part(template: str) -> Column:
    pieces = REF.split(template)
    return F.concat(*(_value(p) if i % 2 else F.lit(p) for i, p in enumerate(pieces)))  # null if a reference is


def _parts(templates: Words, between: str) -> Column:
    return F.concat_ws(between, *map(_part, templates)) if templates else F.lit("")


def _own(rule: Rule) -> str:
    """The lookup whose node a rule tells: its node's template is "{lookup.node_id}"."""
    found = re.fullmatch(r"\{(\w+)\.node_id\}", rule.node)
    return found[1] if found else ""


def _guard(rule: Rule) -> Column:
    text, norm, named = F.col("text"), F.col("_norm"), F.col("entities")
    has = lambda e: F.try_element_at(named, F.lit(e)).isNotNull()
    holds = [any_of(text, g) for g in rule.text] + [any_of(norm, g) for g in rule.norm]
    holds += [~any_of(text, rule.not_text)] * bool(rule.not_text) + [~any_of(norm, rule.not_norm)] * bool(rule.not_norm)
    holds += [has(e) for e in rule.named] + [~has(e) for e in rule.unnamed] + [F.col(f) for f in rule.flags] + [~F.col(f) for f in rule.unflagged]
    holds += [_value(r).isNotNull() for r in (*rule.needs, *([f"{_own(rule)}.node_id"] if _own(rule) else []))]
    return F.coalesce(reduce(and_, holds, F.lit(True)), F.lit(False))


def _told(rule: Rule) -> Column:
    node = _part(rule.node) if rule.node else F.lit(None)
    return F.struct(F.lit(rule.name).alias("name"), F.lit(rule.score).alias("score"), _parts(rule.answer, " ").alias("answer"), _parts(rule.context, "").alias("context"), node.cast("string").alias("node_id"))


def looked_up(questions: DataFrame, nodes: DataFrame, edges: DataFrame, lookups: dict[str, Lookup]) -> DataFrame:
    """``questions`` with a column (node_id, attrs) for each lookup, null where there is no such node."""
    for name, look in lookups.items():
        found = nodes.select("node_id", F.struct("node_id", "attrs").alias(f"_{name}"))
        if look.of:
            near = edges.join(nodes.where(F.col("node_type") == look.node_type).select(F.col("node_id").alias("dst"), "attrs"), "dst")
            found = near.groupBy(F.col("src").alias("node_id")).agg(F.min_by(F.struct(F.col("dst").alias("node_id"), "attrs"), "dst").alias(f"_{name}"))
        key = F.col(f"_{look.of}.node_id") if look.of else _part(look.key)
        questions = questions.withColumn("_key", key).join(found.withColumnRenamed("node_id", "_id"), F.col("_key") == F.col("_id"), "left").drop("_key", "_id")
    return questions


def static_text(title: Column, attrs: Column, skip: Words = ("구분",)) -> Column:
    """A title, and a line for each attribute that has a value, by name; those that begin with _ are left out."""
    entries = F.array_sort(F.filter(F.map_entries(attrs), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & ~e["key"].isin(*skip) & ~e["key"].startswith("_")))
    return F.array_join(F.concat(F.array(title), F.transform(entries, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))), "\n")


def decide(questions: DataFrame, nodes: DataFrame, edges: DataFrame, handlers: tuple[Handler, ...], lookups: dict[str, Lookup]) -> DataFrame:
    """(query_id, pos, name, score, answer, context, node_id) for questions (query_id, intent, text, entities, unit, and what templates and flags name)
    over nodes (node_id, node_type, attrs) and edges (src, dst, relation). answer is empty where only a context is told. A node's attribute _unit says
    to which unit's questions it belongs where all of a type are told."""
    asked = looked_up(questions.withColumn("_norm", normalized(F.col("text"))), nodes, edges, lookups)

    def of(handler: Handler) -> Column:
        one = first([(_guard(r), F.array(_told(r))) for r in handler.first]) if handler.first else F.lit(None)
        some = F.array_compact(F.array(*(F.when(_guard(r), _told(r)) for r in handler.rest))) if handler.rest else None
        return F.coalesce(*(x for x in (one if handler.first else None, some) if x is not None))

    cases = [((F.col("intent") == h.intent) & reduce(and_, (_value(g).isNotNull() for g in h.gate), F.lit(True)), of(h)) for h in handlers]
    found = asked.select("query_id", "intent", "unit", first(cases).alias("told"))
    rows = found.select("query_id", F.posexplode("told").alias("pos", "t")).select("query_id", "pos", "t.*")
    # a node that isn't there isn't told
    told = rows.join(nodes.select("node_id", "node_type", "attrs"), "node_id", "left").where("node_id IS NULL OR node_type IS NOT NULL")
    text = F.when(F.col("node_type").isNotNull() & (F.col("context") == ""), static_text(F.concat(F.coalesce(F.try_element_at("attrs", F.lit("구분")), "node_type"), F.lit(" 안내")), F.col("attrs"))).otherwise(F.col("context"))
    told = told.select("query_id", "pos", "name", "score", "answer", text.alias("context"), "node_id")
    whole = [h for h in handlers if h.every]
    if not whole:
        return told
    every = reduce(DataFrame.unionByName, (_all_of(h, found, told, nodes) for h in whole))
    return told.unionByName(every)


def _all_of(handler: Handler, asked: DataFrame, told: DataFrame, nodes: DataFrame) -> DataFrame:
    node_type, score, most = handler.every
    by_id = Window.partitionBy("unit").orderBy("node_id")
    listed = nodes.where(F.col("node_type") == node_type).withColumn("unit", F.coalesce(F.try_element_at("attrs", F.lit("_unit")), F.lit("")))
    listed = listed.withColumn("pos", F.row_number().over(by_id) - 1).where(F.col("pos") < most) if most else listed.withColumn("pos", F.lit(0))
    quiet = asked.where(F.col("intent") == handler.intent).join(told.select("query_id"), "query_id", "left_anti")
    text = static_text(F.concat(F.coalesce(F.try_element_at("attrs", F.lit("구분")), "node_type"), F.lit(" 안내")), F.col("attrs"))
    pairs = quiet.select("query_id", "unit").join(listed, "unit")
    return pairs.select("query_id", "pos", F.lit("every").alias("name"), F.lit(score).alias("score"), F.lit("").alias("answer"), text.alias("context"), "node_id")
