"""Stages for models that are given to the library: text encoders and scorers of pairs, in batches within tasks.

A model comes as a function that makes it, called once in each Python worker, so that weights are loaded where they are used and
never travel with the plan. It maps a batch to one result a row; results don't depend on how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], np.ndarray]


def _retried(model: Callable, times: int) -> Callable:
    def call(*batch):
        for left in range(times, 0, -1):
            try:
                return model(*batch)
            except Exception:  # noqa: BLE001  a model behind a service may fail for a while; the last failure fails the task
                if left == 1:
                    raise

    return call


def embedded(rows: DataFrame, text: str, make: Callable[[], Encoder], into: str = "embedding", batch_rows: int = 64, tries: int = 2) -> DataFrame:
    """``rows`` with the encoder's vector of each text, in the precision it gives; a null text is encoded as an empty one."""

    def make_predict() -> Callable[[np.ndarray], np.ndarray]:
        encode = _retried(make(), tries)
        return lambda texts: np.asarray(encode([str(t) for t in texts]), np.float64)

    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_rows)
    return rows.withColumn(into, udf(F.coalesce(F.col(text), F.lit(""))))


def scored(pairs: DataFrame, question: str, text: str, make: Callable[[], Scorer], into: str = "score", batch_rows: int = 32, tries: int = 2) -> DataFrame:
    """``pairs`` with the scorer's number for each question and text; nulls are scored as empty texts."""

    def make_predict() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        score = _retried(make(), tries)
        return lambda questions, texts: np.asarray(score([str(q) for q in questions], [str(t) for t in texts]), np.float64)

    udf = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_rows)
    return pairs.withColumn(into, udf(F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
