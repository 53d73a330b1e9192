"""Maximal periodic runs of words, by the runs theorem.

Every run has a root that is the longest Lyndon word at its first place under the order of words or under its reverse.
These words end where the inverse suffix array has its next smaller (or next greater) value. Each is extended to both
sides by longest common extensions: range minima of the LCP array, from a sparse table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import _common, _words

SLICE_BYTES = 1 << 20


class Runs(NamedTuple):
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def pieces_of_repeats(words: np.ndarray, text: np.ndarray, times: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that may lie in a run, and the stretch that each belongs to.

    A word of a run occurs ``times`` times in it at least. So words that are rarer within their stretch cut it, again and
    again, until none is; stretches of fewer than ``shortest`` words go.
    """
    at, stretch = np.arange(len(words)), text
    while len(at):
        key = _words.mix(words[at] ^ (stretch.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        head = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        often = np.empty(len(at), np.int64)
        often[order] = np.repeat(np.diff(head, append=len(at)), np.diff(head, append=len(at)))
        kept = np.flatnonzero(often >= times)
        whole = len(kept) == len(at)
        at, stretch = at[kept], stretch[kept]
        if not len(at):
            break
        first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(stretch, prepend=-1) != 0))
        size = np.diff(first, append=len(at))
        stretch = np.repeat(np.arange(len(first)), size)
        long = np.repeat(size >= shortest, size)
        if whole and long.all():
            break
        at, stretch = at[long], stretch[long]
    return at, stretch


class Suffixes:
    """Suffix ranks and the LCP array of a sequence in which every stretch ends with a mark of its own, less than all words."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        head = np.flatnonzero(np.diff(symbols[order], prepend=symbols[order[0]] - 1))
        size = np.diff(head, append=n)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(head, size)
        levels = [rank.astype(np.int32)]  # at level k: the place of the first suffix with the same 2**k words
        open_ = order[np.repeat(size > 1, size)]
        step = 1
        while len(open_):
            key = rank[open_] * n + rank[open_ + step]
            by = np.argsort(key)
            open_, key = open_[by], key[by]
            place = np.arange(len(open_))
            old = rank[open_]
            group = np.flatnonzero(np.diff(old, prepend=-1))
            within = place - np.repeat(group, np.diff(group, append=len(open_)))
            head = np.flatnonzero(np.diff(key, prepend=-1))
            size = np.diff(head, append=len(open_))
            rank[open_] = np.repeat(old[head] + within[head], size)
            levels.append(rank.astype(np.int32))
            open_ = open_[np.repeat(size > 1, size)]
            step *= 2
        self.rank = rank
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        a, b, common = suffix[:-1], suffix[1:], np.zeros(max(0, n - 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            common += (levels[k][a + common] == levels[k][b + common]).astype(np.int64) << k
        self.minima = [common.astype(np.int32)]
        while (width := 1 << len(self.minima)) <= n - 1:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: n - width], last[width // 2 :][: n - width]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common extension from places i and j (different) to the right."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            on = np.flatnonzero(level == k)
            out[on] = np.minimum(self.minima[k][lo[on]], self.minima[k][hi[on] - (1 << k)])
        return out


def next_smaller(values: list[int]) -> list[int]:
    """The next place with a smaller value; the length if there is none."""
    out, open_ = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            out[open_.pop()] = i
        open_.append(i)
    return out


def runs_of(words: np.ndarray, text: np.ndarray, shortest: int = 6, times: int = 4) -> Runs:
    """The runs of at least ``shortest`` words and ``times`` periods within each text, by start, then period.

    words: a number for each word (equal words have equal ones); text: the text of each word, ascending.
    """
    at, stretch = pieces_of_repeats(words, text, times, shortest)
    none = np.zeros(0, np.int64)
    if not len(at):
        return Runs(none, none, none)
    number = np.unique(words[at], return_inverse=True)[1]
    count = int(stretch[-1]) + 1
    place = np.arange(len(at)) + stretch  # one mark after each stretch
    symbols = np.empty(len(at) + count, np.int64)
    symbols[place] = number + count
    ends = np.flatnonzero(np.diff(stretch, append=count)) + 1
    symbols[ends + np.arange(count)] = np.arange(count)
    origin = np.full(len(symbols), -1)
    origin[place] = at
    suffixes = Suffixes(symbols)
    ranks = suffixes.rank
    i = np.tile(np.arange(len(symbols)), 2)
    root_end = np.array(next_smaller(ranks.tolist()) + next_smaller((-ranks).tolist()))
    p = root_end - i
    usable = (root_end < len(symbols)) & (origin[i] >= 0)
    i, p = i[usable], p[usable]
    needed = np.maximum(shortest, times * p)
    right = suffixes.common(i, i + p)
    # the first such root of a run begins less than a period from its start; the others tell nothing new
    hopeful = right + 2 * p > needed
    i, p, right, needed = i[hopeful], p[hopeful], right[hopeful], needed[hopeful]
    low, high = np.zeros(len(i), np.int64), np.minimum(p, i)
    while (low < high).any():  # the longest extension to the left: what matches from there reaches i
        middle = (low + high + 1) // 2
        reaches = (middle == 0) | (suffixes.common(i - middle, i - middle + p) >= middle)
        low, high = np.where(reaches, middle, low), np.where(reaches, high, middle - 1)
    length = low + p + right
    whole = (low < p) & (length >= needed)
    table = np.unique(np.stack([origin[(i - low)[whole]], p[whole], length[whole]], 1), axis=0)
    return Runs(table[:, 0], table[:, 2], table[:, 1])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 6, times: int = 4) -> DataFrame:
    """(key, n_words, runs, collapsed) for each row of ``docs``.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged, numbered from 0. runs: (start, length, period) of every stretch with
    smallest period q and a length of at least ``shortest`` and ``times`` * q (2 or more) that no neighbouring word
    extends, by start, then period. collapsed: the words, joined by one space, without those that a run repeats after
    its first q. Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows get a result
    each; other columns are ignored; an empty table gives an empty result. A whole text is parsed at once (some 400
    bytes for each word that recurs within it). Words are told apart by 64-bit hashes.
    """
    if times < 2 or shortest < 1:
        raise ValueError("a run has two periods at least")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for part in _common.in_slices(batches, "text", SLICE_BYTES):
            column = part.column("text")
            data, offsets = _common.string_parts(column)
            data, found = _words.split(data, offsets, _words.SPACE_WORD)
            runs = runs_of(_words.hashes(data, found), _words.text_of(found), shortest, times)
            of = np.searchsorted(found.first, runs.start, side="right") - 1
            dropped = np.zeros(len(found.start) + 1, np.int64)
            np.add.at(dropped, runs.start + runs.period, 1)
            np.add.at(dropped, runs.start + runs.length, -1)
            dropped = dropped.cumsum() > 0
            collapsed: list[bytes] = []
            repetitive = set(of.tolist())
            for k in range(part.num_rows):
                words = data[offsets[k] : offsets[k + 1]].tobytes().split()
                if k in repetitive:
                    words = [words[j] for j in np.flatnonzero(~dropped[found.first[k] : found.first[k + 1]]).tolist()]
                collapsed.append(b" ".join(words))
            members = pa.StructArray.from_arrays([pa.array(runs.start - found.first[of]), pa.array(runs.length), pa.array(runs.period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)), members).cast(kind)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found.count.astype(np.int64)), lists, pa.array(collapsed, pa.string())], ["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), _common.text_or_empty(text).alias("text"))
    schema = rows.select("key").schema.add("n_words", "long").add("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))).add("collapsed", "string")
    return _common.bounded(rows).mapInArrow(parse, schema).withColumnRenamed("key", key)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with the tail of every tenth text, by the checksum of its id, overwritten by repetitions of the tail's first words. A null id leaves the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    planted = F.expr("array_join(transform(sequence(0L, n - 1), i -> get(words, int(IF(i < a, i, a + (i - a) % p)))), ' ')")
    g, n = F.expr("h div 10"), F.size("words").cast("long")
    chosen = docs.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)"))
    return chosen.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    best = F.expr("aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (b, r) -> IF(b IS NULL OR r.length * b.period > b.length * r.period, r, b))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
