"""The corpus pipeline, stage by stage, on a small table with odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import pii, toxicity
from tests.llm import brute
from tests.llm.conftest import SF
from tests.llm.test_operators import ALL_ODD


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """documents with copies, near copies, passages of the benchmark, personal data, nulls and repeated rows."""
    d = str(tmp_path_factory.mktemp("pipeline"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(11)
    prose = lambda n: " ".join(f"t{rng.randrange(5000)}" for _ in range(n))
    texts = [prose(rng.randrange(5, 200)) for _ in range(60)]
    for i in range(10):
        words = texts[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts += [" ".join(words), texts[i + 10]]
    texts += [prose(30) + " " + items[3][1] + " " + prose(30), "reach me at joe.doe@example.com today " + prose(30)]
    rows = [(i + 100, t, "en", f"src{i % 4}" if i % 7 else None) for i, t in enumerate(texts)] + [(k, t, "en", s) for k, t, s in ALL_ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("id", "taken", "key", "exact", "component_id"):
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{d}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    return d


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    clean = stages[0](spark, docs, sf)
    scored = toxicity.score_toxicity(docs, labels)
    assert clean.columns == columns and clean.count() == scored.where("predicted = 0").count()

    single = stages[1](spark, clean, sf)
    groups = {k: c for k, _, c in brute.jaccard(rows(clean), 5, 80)}
    assert single.columns == columns
    assert sorted(rows(single), key=str) == sorted(((k, t) for k, t in rows(clean) if k is None or groups[k] == k), key=str)

    fresh = stages[2](spark, single, sf)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute.decontaminate(rows(single), items) if r[5] and r[0] is not None}
    assert hit and fresh.columns == columns
    assert sorted(rows(fresh), key=str) == sorted(((k, t) for k, t in rows(single) if k not in hit), key=str)

    masked = stages[3](spark, fresh, sf)
    assert masked.columns == columns and masked.count() == fresh.count()
    assert not any(pii.detect(t or "") for _, t in rows(masked))
    assert masked.where("n_chars != length(text)").count() == 0
    untouched = {(k, t) for k, t in rows(fresh) if not pii.scan(t or "")[1]}
    assert untouched <= set(rows(masked))

    mixed = stages[4](spark, masked, sf)
    assert set(mixed.columns) == set(columns) and mixed.where("taken <= 0").count() == 0
    sizes = {k: len(brute.SPACE_WORD.findall(t or "")) for k, t in rows(masked)}
    assert all(r["taken"] <= 3 * sizes[r["doc_id"]] * 2 for r in mixed.collect())


def test_run_is_the_stages(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert found.count() > 0 and found.where("taken <= 0").count() == 0


def test_empty(spark, sf, tmp_path):
    d = str(tmp_path)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{d}/{name}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
