"""Answers from the graph by intent: decision tables, and what they say of a question beside its analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import handler_rules as rules
from corvane.functions.questions import first
from corvane.functions.text import any_of, normalized, registration_group, reports_trouble, student_group
from corvane.operators import decisions


def described(questions: DataFrame) -> DataFrame:
    """Questions (query_id, intent, text, student_id, student_type, entities, unit) with all that the tables' guards and templates name.

    unit tells apart the graphs of several units in one table of nodes; it may be empty.
    """
    year, text, norm = F.col("student_id"), F.col("text"), normalized(F.col("text"))
    entity = lambda name: F.try_element_at("entities", F.lit(name))
    rows = questions.withColumns(
        {
            "group": F.when(year.isNotNull(), student_group(year)).otherwise(F.lit("")),
            "reg_group": registration_group(F.coalesce(year, F.lit("2023"))),
            "early_group": F.when(year.try_cast("int") <= 2022, "2022이전").otherwise("2023이후"),
            "has_year": F.coalesce(year.rlike("^[0-9]{4}$"), F.lit(False)),
            "is_domestic": F.col("student_type") == "내국인",
            "is_foreign": F.col("student_type") == "외국인",
            "is_transfer": F.col("student_type") == "편입생",
            "trouble": reports_trouble(text),
            "asks_ocu": entity("ocu").isNotNull() | any_of(norm, ("ocu", "사이버")),
            "asks_carry": text.contains("학점이월") | (text.contains("이월") & text.contains("학점")),
            "major_method": entity("major_method"),
            "department": entity("department"),
            "course_name": entity("course_name"),
        }
    )
    label = first([(F.col("group") == k, F.lit(v)) for k, v in rules.GROUP_LABELS.items()], F.concat("group", F.lit("학번")))
    return rows.withColumns({"label": label, "reg_label": F.when(F.col("reg_group") == "2023이후", "2023학번 이후").otherwise("2022학번 이전")})


def answers(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, pos, name, score, answer, context, node_id) for questions as ``described`` takes them, of all intents that have a table."""
    return decisions.decide(described(questions), nodes, edges, rules.HANDLERS, rules.LOOKUPS).unionByName(leave(questions, nodes))


def leave(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of kinds of leave that a question names; if it names none that is there, the first two of its unit."""
    asked = questions.where("intent = 'LEAVE_OF_ABSENCE'").select("query_id", "unit", normalized(F.col("text")).alias("norm"))
    listed = nodes.where("node_type = '휴복학'").withColumn("section", normalized(F.coalesce(F.try_element_at("attrs", F.lit("구분")), F.lit(""))))
    listed = listed.withColumn("kinds", F.array_compact(F.array(*(F.when(any_of(F.col("section"), (kind, *words)), F.lit(kind)) for kind, words in rules.LEAVE_KINDS.items()))))
    listed = listed.withColumn("unit", F.coalesce(F.try_element_at("attrs", F.lit("_unit")), F.lit("")))
    kinds = F.array_compact(F.array(*(F.when(any_of(F.col("norm"), words), F.lit(kind)) for kind, words in rules.LEAVE_KINDS.items())))
    named = asked.select("query_id", "unit", F.explode(kinds).alias("kind")).join(listed.select("unit", "node_id", F.explode("kinds").alias("kind")), ["unit", "kind"]).select("query_id", "node_id").distinct()
    by_id = Window.partitionBy("unit").orderBy("node_id")
    score, most = rules.ANY_LEAVE
    few = listed.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= most)
    rest = asked.join(named.select("query_id"), "query_id", "left_anti").join(few, "unit").select("query_id", "node_id", F.lit("any").alias("name"), F.lit(score).alias("score"))
    told = named.select("query_id", "node_id", F.lit("kind").alias("name"), F.lit(rules.LEAVE_SCORE).alias("score")).unionByName(rest)
    text = decisions.static_text(F.concat(F.coalesce(F.try_element_at("attrs", F.lit("구분")), "node_type"), F.lit(" 안내")), F.col("attrs"))
    return told.join(nodes, "node_id").select("query_id", F.lit(0).alias("pos"), "name", "score", F.lit("").alias("answer"), text.alias("context"), "node_id")
