"""Shared plumbing: intermediate tables on shared storage, and byte-bounded Arrow slices."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that holds texts, about (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_written: list[tuple[SparkSession, str]] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and what reads it survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/corvane/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    _path_of[table] = path
    return table


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed by ``release``."""
    path = f"{scratch_dir(spark)}/corvane/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again, and shuffle files of jobs whose results are written.

    Spark's cleaner drops those files once the driver's garbage is collected, which by itself may not happen for long.
    """
    for table in tables:
        if path := _path_of.pop(table, None):
            _delete(spark, path)
            _written[:] = [x for x in _written if x[1] != path]
    gc.collect()
    spark._jvm.System.gc()


def release() -> None:
    """Delete every intermediate table written so far; call it once the results that read them are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
            return


atexit.register(release)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_BYTES``: rows with long texts then need no large buffers."""
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH_BYTES, str(1 << 30)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return df


#: Bits of a key filter at most (8 MB); more keys than a sixteenth of that let more rows through.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame) -> tuple[np.ndarray, int]:
    """Packed bits of which every key of ``keys`` (one column) has one set, and their number; no more than 1/16 are set
    while there are few enough keys. A fixed size at most comes to the driver and goes to the tasks."""
    name = keys.columns[0]
    bits = 1 << 12
    wanted = 16 * keys.count()
    while bits < min(FILTER_BITS, wanted):
        bits <<= 1
    at = keys.select(slot(name, bits).alias("x"))
    words = at.groupBy(F.shiftright("x", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, x & 63)")).alias("bits")).toPandas()
    packed = np.zeros(bits >> 6, np.int64)
    packed[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return packed, bits


def slot(name: str, bits: int) -> "F.Column":
    return F.pmod(F.xxhash64(name), F.lit(bits)).cast("int")


def passes(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (packed[slots >> 6] >> (slots & 63) & 1).astype(bool)


def text_or_empty(column: str) -> "F.Column":
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def string_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls become empty strings."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def in_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds at most ``limit`` bytes in each (or one row)."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = string_parts(batch.column(batch.schema.get_field_index(column)))
            for lo, hi in byte_slices(offsets, limit):
                yield batch.slice(lo, hi - lo)
