"""Injected models: the same results whatever the batches; failures that pass are tried again."""

from __future__ import annotations

import numpy as np
import pytest

from corvane.operators import models


def lengths():
    return lambda texts: np.array([[len(t), t.count("a"), 1.0] for t in texts])


def shared():
    return lambda questions, texts: np.array([len(set(q.split()) & set(t.split())) for q, t in zip(questions, texts, strict=True)], float)


def now_and_then():
    calls = iter(range(10**6))

    def encode(texts):
        if next(calls) % 2 == 0:
            raise OSError("busy")
        return lengths()(texts)

    return encode


def always_down():
    def encode(texts):
        raise OSError("down for good")

    return encode


@pytest.mark.parametrize("batch", [1, 7, 500])
def test_results_do_not_depend_on_batches(spark, batch):
    texts = [(i, None if i % 9 == 0 else "a b " * (i % 5) + str(i), "b c") for i in range(60)]
    rows = spark.createDataFrame(texts, "i int, t string, u string").repartition(3)
    for make in (lengths, now_and_then):
        found = {r["i"]: r["embedding"] for r in models.embedded(rows, "t", make, batch_rows=batch).collect()}
        assert found == {i: [len(t or ""), (t or "").count("a"), 1.0] for i, t, _ in texts}
    scores = {r["i"]: r["score"] for r in models.scored(rows, "t", "u", shared, batch_rows=batch).collect()}
    assert scores == {i: float("b" in (t or "").split()) for i, t, _ in texts}
    assert models.embedded(rows.limit(0), "t", lengths).count() == 0


def test_a_lasting_failure_is_told(spark):
    with pytest.raises(Exception, match="down for good"):
        models.embedded(spark.createDataFrame([("x",)], "t string"), "t", always_down).collect()


def test_vectors_keep_their_precision(spark):
    thirds = lambda: lambda texts: np.array([[len(t) / 3, 0.48685000000001] for t in texts])
    found = models.embedded(spark.createDataFrame([("x",), ("xyzab",)], "t string"), "t", thirds).collect()
    assert {tuple(r["embedding"]) for r in found} == {(1 / 3, 0.48685000000001), (5 / 3, 0.48685000000001)}
