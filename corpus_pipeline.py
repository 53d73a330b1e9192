"""The corpus pipeline: five stages, each of which works on all that the one before kept.

Toxic documents go; of each group of near copies (word shingles of five, similarity 0.8 or more) the one with the
smallest id stays; documents with passages of the benchmark go; personal data are masked; the rest is mixed by source.

Each stage takes null and empty texts, null ids, repeated rows, empty tables and further columns, and returns all columns that it was given:
a decision about an id holds for all rows with that id, whatever their texts; a row with a null id is never dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _common, toxicity
from corvane.llm.decontaminate import decontaminate
from corvane.llm.jaccard import jaccard_groups
from corvane.llm.mixing import mix
from corvane.llm.pii import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't among ``ids`` (one column, doc_id). A null id is never among them.

    The ids are written first: Spark then knows their size, and spares the texts a shuffle if they are few.
    """
    ids = _common.materialize(ids.where("doc_id IS NOT NULL").distinct(), "dropped")
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text scores as toxic go, whatever their id; null and empty texts have the score of a text without hits."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the rows with its smallest id stay, all of them if several have it; texts without words are in no group."""
    groups = jaccard_groups(docs)
    return _without(docs, groups.where("component_id != doc_id").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the id of a row that has a window of an item go; texts without words have none."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("n_hit > 0").select("doc_id"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Row by row: repeated rows are masked alike, a null text stays null. n_chars, where the table has it, is that of the new text."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with taken: these words, repeats counted (of all rows with the id)."""
    taken = mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias("_mixed_id")).agg(F.sum("taken").alias("_mixed"))
    mixed = docs.drop("taken", "_mixed", "_mixed_id").join(taken, F.col("doc_id").eqNullSafe(F.col("_mixed_id")))
    return mixed.drop("_mixed_id").withColumnRenamed("_mixed", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("mixing sources", mix_sources),
]
#: SQL expresses neither the learned scores nor the connected components in reasonable time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _common.materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
