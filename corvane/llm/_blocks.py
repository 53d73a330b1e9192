"""Documents dealt into blocks of about equal bytes, by a hash of their key.

A block is small enough for one task whatever the table's size, no source or group of copies shares it by design,
and its questions to the rest of the corpus (about hashes, sorted into buckets) are asked once for all its texts.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _common, _words

#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20


def in_blocks(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(key, text, block) and the number of blocks; null texts become empty, rows with one key share a block."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, ceil(total / block_bytes))
    rows = docs.select(F.col(key).alias("key"), _common.text_or_empty(text).alias("text"))
    return rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")), blocks


def bucket_of(hashed: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by bits that the hash's order doesn't use."""
    return (_words.mix(hashed + np.uint64(0x632BE59BD9B4E019)) % np.uint64(buckets)).astype(np.int64)


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` by its keys in ``parts`` partitions where the session's number of them is smaller; grouping then keeps them."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys) if parts > usual else df
