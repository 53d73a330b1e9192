"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are runs of ``window`` consecutive words (one shorter window if the item has fewer). Each is
the set of its word shingles with their places. A text can hold a window only if it holds all of its shingles,
so one of them, the rarest over all texts, is a sufficient prefix: texts and windows are joined on that shingle.
A joined pair says where in the text the window would begin; the length and positional bounds drop pairs that
would stick out of the stretch of text at hand, and the rest are verified word by word.

Texts are read once. A bitmap of the items' shingles, of a fixed size, picks from each text the stretches whose
shingles are all possible ones; only these go on, with their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _common, _words

#: Bits of each bitmap: its size is bounded whatever the number of items (more items only let more stretches through).
BITS = 1 << 23
SLICE_BYTES = 1 << 20
_STRETCHES = "array<struct<at: int, k: int, words: array<string>, keys: array<long>>>"


def _split(column: pa.Array) -> tuple[bytes, _words.Words, np.ndarray]:
    data, words = _words.split(*_common.string_parts(column), _words.ALNUM_WORD, lower=True)
    return data.tobytes(), words, _words.hashes(data, words)


def _strings(raw: bytes, words: _words.Words, lo: int, hi: int) -> list[str]:
    return [raw[s:e].decode() for s, e in zip(words.start[lo:hi].tolist(), words.end[lo:hi].tolist(), strict=True)]


def item_windows(items: DataFrame, item: str, text: str, window: int, shingle: int) -> DataFrame:
    """(item, words, k, keys): each distinct window of each item with the hashes of its shingles of k words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _common.in_slices(batches, "text", SLICE_BYTES):
            raw, words, hashed = _split(part.column("text"))
            rows: dict[str, list] = {"item": [], "words": [], "k": [], "keys": []}
            ids = part.column("item").to_pylist()
            for i, (lo, hi) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                if lo == hi:
                    continue
                size = min(window, hi - lo)
                k = min(shingle, size)
                keys = _words.windows(hashed[lo:hi], k).view(np.int64).tolist()
                strings = _strings(raw, words, lo, hi)
                for at in range(hi - lo - size + 1):
                    rows["item"].append(ids[i])
                    rows["words"].append(strings[at : at + size])
                    rows["k"].append(k)
                    rows["keys"].append(keys[at : at + size - k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(rows["item"], part.column("item").type), pa.array(rows["words"], pa.list_(pa.string())), pa.array(rows["k"], pa.int32()), pa.array(rows["keys"], pa.list_(pa.int64()))], names=list(rows))

    kind = items.schema[item].dataType.simpleString()
    source = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), _common.text_or_empty(text).alias("text"))
    return source.mapInArrow(cut, f"item {kind}, words array<string>, k int, keys array<long>").distinct()


def stretches(docs: DataFrame, key: str, text: str, bitmaps: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """(row, key, n_words, found): per text the stretches in which every shingle is in the bitmap of its k.

    bitmaps: per shingle length k the packed bits, and the fewest shingles in a row that any window of that k has.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {k: (np.unpackbits(bits).view(bool), least) for k, (bits, least) in bitmaps.items()}
        for part in _common.in_slices(batches, "text", SLICE_BYTES):
            raw, words, hashed = _split(part.column("text"))
            found: list[list] = [[] for _ in range(part.num_rows)]
            for k, (bits, least) in maps.items():
                keys = _words.windows(hashed, k)
                usable = np.zeros(len(keys) + 2, bool)
                at = _words.starts_of(words, k)
                usable[at + 1] = bits[(keys[at] % np.uint64(BITS)).astype(np.int64)]
                cut = np.zeros(len(usable), bool)  # a stretch ends where its text does
                cut[np.minimum(words.first, len(keys)) + 1] = True
                begin = np.flatnonzero(usable[1:-1] & (~usable[:-2] | cut[1:-1]))
                end = np.flatnonzero(usable[1:-1] & (~usable[2:] | cut[2:])) + 1
                long = end - begin >= least
                begin, end = begin[long], end[long]
                owner = np.searchsorted(words.first, begin, side="right") - 1
                for b, e, o in zip(begin.tolist(), end.tolist(), owner.tolist(), strict=True):
                    found[o].append({"at": b - int(words.first[o]), "k": k, "words": _strings(raw, words, b, e + k - 1), "keys": keys[b:e].view(np.int64).tolist()})
            kind = pa.list_(pa.struct([("at", pa.int32()), ("k", pa.int32()), ("words", pa.list_(pa.string())), ("keys", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(words.count, pa.int64()), pa.array(found, kind)], names=["key", "n_words", "found"])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), _common.text_or_empty(text).alias("text"))
    return _common.bounded(source).mapInArrow(pick, f"key {kind}, n_words long, found {_STRETCHES}").withColumn("row", F.monotonically_increasing_id())


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5) -> DataFrame:
    """(key, n_words, n_hit, item_ids, spans) for each row of ``docs``.

    n_words: words of the text. n_hit: those inside any occurrence of an item's window. item_ids: the items with
    such windows, distinct, as sorted strings. spans: (at, size) of every occurrence, in words. Null and empty
    texts have no words; items without words or without an id are never found; repeated rows get a result each;
    an empty table on either side gives no hits. Other columns are ignored.
    """
    spark = docs.sparkSession
    wins = _common.materialize(item_windows(items, item, item_text, window, shingle), "windows")
    shapes = wins.groupBy("k").agg(F.min(F.size("keys")).alias("least")).orderBy("k").collect()  # k is at most ``shingle``
    maps = {}
    for shape in shapes:
        bits = np.zeros(BITS, bool)
        taken = wins.where(F.col("k") == shape["k"]).select(F.explode("keys").alias("x")).select(F.expr(f"int(mod(mod(x, {BITS}) + {BITS}, {BITS}))").alias("b")).distinct().toPandas()  # at most BITS values
        bits[taken["b"].to_numpy(np.int64)] = True
        maps[shape["k"]] = (np.packbits(bits), shape["least"])
    texts = _common.materialize(stretches(docs, key, text, maps), "stretches")
    base = ["row", "key", "n_words"]
    none = texts.where(F.size("found") == 0).select(*base, F.array().cast("array<string>").alias("item_ids"), F.array().cast("array<struct<at: int, size: int>>").alias("spans"))

    run = texts.where(F.size("found") > 0).select(*base, F.explode("found").alias("f")).select(*base, "f.*")
    keys = run.select("row", "k", "at", F.size("words").alias("n"), F.posexplode("keys").alias("pos", "key_hash"))
    often = keys.groupBy("k", "key_hash").agg(F.count("*").alias("often"))
    each = wins.select("item", "k", F.col("words").alias("win"), F.posexplode("keys").alias("offset", "key_hash"))
    # a window one of whose shingles is in no text has no occurrence; else the rarest is its prefix
    prefix = (
        each.join(often, ["k", "key_hash"], "left")
        .groupBy("item", "k", "win")
        .agg(F.min("often").alias("rarest"), F.count("often").alias("present"), F.count("*").alias("all"), F.min(F.struct("often", "key_hash", "offset")).alias("p"))
        .where("present = all")
        .select("item", "k", "win", F.col("p.key_hash").alias("key_hash"), F.col("p.offset").alias("offset"))
    )
    begin = F.col("pos") - F.col("offset")
    # short rows meet by their keys; a stretch's words come only to the windows that may begin in it
    maybe = keys.join(prefix, ["k", "key_hash"]).where((begin >= 0) & (begin + F.size("win") <= F.col("n"))).select("row", "k", "at", begin.alias("begin"), "item", "win")
    hit = (
        run.select("row", "k", "at", "words")
        .join(maybe, ["row", "k", "at"])
        .where(F.slice("words", F.col("begin") + 1, F.size("win")) == F.col("win"))
        .select("row", "item", (F.col("at") + F.col("begin")).alias("at"), F.size("win").alias("size"))
    )
    hits = hit.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("item_ids"), F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"))
    some = texts.where(F.size("found") > 0).select(*base).join(hits, "row", "left")
    some = some.select(*base, F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<at: int, size: int>>")).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(a["upto"], s["at"]))).alias("n"), F.greatest(a["upto"], s["at"] + s["size"]).alias("upto")),
        lambda a: a["n"].cast("long"),
    )
    return none.unionByName(some).select(F.col("key").alias(key), "n_words", covered.alias("n_hit"), "item_ids", "spans")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
