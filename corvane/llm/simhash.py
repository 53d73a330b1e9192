"""Near copies by SimHash: fingerprints in Arrow slices, links through an inverted index on byte positions.

Fingerprints that differ in at most ``bits`` bits differ in at most so many of their eight bytes, so that they share
8 - bits bytes at the same positions at least. That is the number of matches a pair must reach. A list for a single
positional byte would hold a 256th of all fingerprints, and tallies over such lists grow with their square; a list
here is therefore keyed by as many positional bytes as a pair must share. A pair meets in a list exactly if its tally
reaches that number, and a list has no more than 256 ** bits different fingerprints whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _common
from corvane.llm.components import components

SLICE_BYTES = 1 << 20
#: Bytes of one text whose words are held at once, about.
PIECE_BYTES = 4 << 20
#: Hashes whose bits are laid out at once.
UNPACKED = 1 << 14
#: Lists up to this size are compared pair by pair; in larger ones each member's possible neighbours are looked up.
SMALL_LIST = 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """The text cut at white space into pieces of about ``limit`` bytes (a longer word stays whole)."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + limit)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``shingle`` words, in order and with repeats; of the whole sequence if there are fewer words."""
    carried: list[bytes] = []
    none_yet = True
    for piece in pieces(text.lower(), PIECE_BYTES):
        words = carried + piece.split()
        carried = words[max(0, len(words) - shingle + 1) :]
        if len(words) >= shingle:
            none_yet = False
            yield _hashes(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    if none_yet and carried:
        yield _hashes([b" ".join(carried)])


def _hashes(texts: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, texts, repeat(42))), ">u8").astype(np.uint64)


def fingerprints_of(texts: list[bytes], shingle: int) -> np.ndarray:
    """A 64-bit fingerprint of each text: a bit is set if more than half of the shingles' hashes have it."""
    ones = np.zeros((len(texts), 64), np.int64)
    count = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def tally() -> None:
        if held:
            hashed, of = np.concatenate(held), np.concatenate(owner)
            for lo in range(0, len(hashed), UNPACKED):
                bits = np.unpackbits(hashed[lo : lo + UNPACKED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                part = of[lo : lo + UNPACKED]
                first = np.flatnonzero(np.diff(part, prepend=-1))
                ones[part[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            held.clear(), owner.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for hashed in shingle_hashes(text, shingle):
            count[i] += len(hashed)
            held.append(hashed), owner.append(np.full(len(hashed), i))
            if (waiting := waiting + len(hashed)) > 16 * UNPACKED:
                tally()
                waiting = 0
    tally()
    return np.packbits(ones * 2 > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fingerprint as a long) for each row: words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Texts without words have fingerprint zero."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _common.in_slices(batches, "text", SLICE_BYTES):
            texts = [x.encode() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fingerprints_of(texts, shingle).view(np.int64))], ["key", "fingerprint"])

    rows = docs.select(F.col(key).alias("key"), _common.text_or_empty(text).alias("text"))
    return _common.bounded(rows).mapInArrow(count, rows.select("key").schema.add("fingerprint", "long"))


def close_in_lists(members: list[np.ndarray], free: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each list (sorted different fingerprints that agree outside the bits of ``free``), pairs at ``bits`` or fewer differing bits.

    All of them in a list of up to ``SMALL_LIST``; of a larger one, a forest that connects what they connect.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    by_size: dict[int, list[int]] = {}
    for i, m in enumerate(members):
        by_size.setdefault(len(m), []).append(i)
    for size, which in by_size.items():
        if size > SMALL_LIST:
            found += [_forest(members[i], free[i], bits) for i in which]
            continue
        left, right = np.triu_indices(size, 1)
        step = max(1, (1 << 19) // max(1, len(left)))
        for lo in range(0, len(which), step):
            table = np.stack([members[i] for i in which[lo : lo + step]])
            a, b = table[:, left], table[:, right]
            near = np.bitwise_count(a ^ b) <= bits
            found.append((a[near], b[near]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def _forest(members: np.ndarray, free: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    places = [b for b in range(64) if free >> b & 1]
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    kept: list[tuple[int, int]] = []
    for flips in (c for n in range(1, bits + 1) for c in combinations(places, n)):
        other = members ^ np.uint64(sum(1 << b for b in flips))
        at = np.minimum(np.searchsorted(members, other), len(members) - 1)
        for i in np.flatnonzero((members[at] == other) & (members < other)).tolist():
            a, b = root(i), root(int(at[i]))
            if a != b:
                parent[b] = a
                kept.append((i, int(at[i])))
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    return members[pairs[:, 0]], members[pairs[:, 1]]


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): pairs of the different values of ``prints`` (one column of longs) at ``bits`` or fewer differing bits, or a forest of such pairs that connects the same."""
    if not 1 <= bits <= 2:
        raise ValueError("bits must be 1 or 2")
    name = prints.columns[0]
    masks = {sum(0xFF << 8 * p for p in kept) for kept in combinations(range(8), 8 - bits)}
    signed = [m - (1 << 64) if m >> 63 else m for m in sorted(masks)]
    posting = prints.select(F.col(name).alias("member"), F.explode(F.array(*map(F.lit, signed))).alias("mask"))
    lists = posting.groupBy("mask", F.col("member").bitwiseAND(F.col("mask")).alias("shared")).agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                free = [~m & (1 << 64) - 1 for m in part.column("mask").to_pylist()]
                values, ends = part.column("members").flatten().to_numpy().view(np.uint64), part.column("members").value_lengths().to_numpy().cumsum()
                a, b = close_in_lists([np.sort(x) for x in np.split(values, ends[:-1])] if len(ends) else [], free, bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return lists.mapInArrow(verify, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """(key, fingerprint, component_id) for each row of ``docs``; fingerprints link at ``bits`` or fewer differing bits.

    component_id is the smallest key that links reach, the row's own included. Rows with equal fingerprints are one
    class: the index holds each class once, so that groups of copies make no pairs. Null and empty texts, and texts
    without words, have fingerprint zero and link like any other. A text with fewer words than a shingle is one
    shingle. Null keys are passed over as smallest keys (null if no row of the component has one). Repeated rows get a
    result each; other columns are ignored; an empty table gives an empty result.
    """
    rows = _common.materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    classes = _common.materialize(rows.groupBy("fingerprint").agg(F.min("key").alias("least")), "classes")
    near = components(_common.materialize(links(classes.select("fingerprint"), bits), "links"))
    placed = classes.join(near.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("fingerprint", "component").join(least, "component").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
