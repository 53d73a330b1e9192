"""The daily question log and JSON collections as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = (
    "timestamp timestamp, session_id string, student_id string, intent string, question string, answer string, duration_ms long, rating int, context_confidence double, user_id long, chat_message_id long"
)
QUESTION_SCHEMA = (
    "id string, lang string, question string, answer string, ground_truth string, key_facts array<string>, intent string, category string, difficulty string, answerable boolean, source string,"
    " source_page int, evidence_page array<int>, check_language boolean, note string"
)


def append_log(rows: DataFrame, path: str) -> None:
    """Add a JSON line a row to the files of its day; rows without a time go to no day's files and are refused."""
    dated = rows.withColumn("log_date", F.to_date("timestamp"))
    checked = dated.withColumn("log_date", F.when(F.col("log_date").isNotNull(), F.col("log_date")).otherwise(F.raise_error(F.lit("a log row without a time")).cast("date")))
    checked.write.mode("append").partitionBy("log_date").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All days' rows with ``log_date``; lines that aren't JSON objects are left out, values of a wrong type are null."""
    lines = spark.read.text(path).where(F.json_object_keys("value").isNotNull())
    return lines.select(F.from_json("value", LOG_SCHEMA).alias("row"), "log_date").select("row.*", "log_date")


def read_questions(spark: SparkSession, path: str, lang: str = "ko") -> DataFrame:
    """Question sets in their one form: truth and evidence under one name each, languages and answerability filled in."""
    rows = spark.read.schema(QUESTION_SCHEMA).json(path)
    return rows.select(
        "id", F.coalesce("lang", F.lit(lang)).alias("lang"), "question", F.coalesce("ground_truth", "answer").alias("ground_truth"), F.coalesce("key_facts", F.array().cast("array<string>")).alias("key_facts"), "intent", "category",
        "difficulty", F.coalesce("answerable", F.lit(True)).alias("answerable"), "source", F.coalesce("evidence_page", F.array_compact(F.array("source_page"))).alias("evidence_page"), F.coalesce("check_language", F.lit(False)).alias("check_language"), "note",
    )


def read_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that is one list of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
