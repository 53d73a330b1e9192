"""Scores of texts under models learned from the corpus: prediction by partial matching, and a word-count base.

The model is a byte-context trie: after the last ``ORDER`` bytes of a text, each next byte (or the end) has the counts
of all training texts. A byte that a context has never seen escapes to the context one byte shorter, and so on down to
all bytes alike; the shorter context's counts leave out the bytes that the longer one has seen (symbol exclusion; the
contexts are nested, so sums suffice for it). Escapes are estimated by the number of different bytes seen (method C).
A text's score is the log10 probability of its bytes and its end.

Neither the trie nor the word counts are bounded, so neither is broadcast. Texts are dealt into blocks. Each block tells
the buckets of both tables its own counts and asks about its distinct words and byte sequences, each once, and scores
its texts with the answers. A bucket of the trie has all contexts with the same last two bytes, so it is a whole
subtree; the two shortest levels, 65,792 counts at most, are given to every bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _blocks, _common, _words

SLICE_BYTES = 1 << 20
#: Text bytes whose words and grams make a bucket of each table, about.
BUCKET_BYTES = 24 << 20
#: Bytes of the longest context, from 2 to 7.
ORDER = 5
#: A byte that UTF-8 never has: the start and the end of a text.
MARK = 0xFF


def held_out(key: Column, of: int = 10) -> Column:
    """Whether crc32 of the key as text leaves no remainder; a null key isn't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of == 0, F.lit(False))


def byte_grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each predicted byte its ``order`` predecessors and itself as one number; and where each text's begin (and the end)."""
    n = len(offsets) - 1
    padded = np.full(len(data) + (order + 1) * n, MARK, np.uint8)
    padded[np.arange(len(data)) + np.repeat((order + 1) * np.arange(n) + order, np.diff(offsets))] = data
    grams = np.zeros(max(0, len(padded) - order), np.uint64)
    for j in range(order + 1):
        grams = (grams << np.uint64(8)) | padded[j : len(padded) - order + j]
    first = offsets + np.arange(n + 1)
    where = np.arange(first[-1]) + np.repeat(order * np.arange(n), np.diff(first))  # a text's marks are predicted by nothing
    return grams[where], first


def _suffix(grams: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes."""
    return grams & np.uint64((1 << (8 * size)) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Level:
    """The contexts of one length: sorted grams with counts, and each context's total and number of kinds."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams, self.counts = grams, counts
        self.contexts, self.first = np.unique(grams >> np.uint64(8), return_index=True)
        self.total = np.add.reduceat(counts, self.first)
        self.kinds = np.diff(np.append(self.first, len(grams)))


def probabilities(asked: np.ndarray, grams: np.ndarray, counts: np.ndarray, order: int, bigrams: np.ndarray) -> np.ndarray:
    """The probability of each asked gram's last byte after the others.

    grams, counts: a subtree's training grams (order + 1 bytes), distinct and sorted. bigrams: counts of all pairs.
    """
    levels: dict[int, Level] = {}
    for size in range(order, 1, -1):
        if len(grams):
            levels[size] = Level(grams, counts)
            grams, which = np.unique(_suffix(grams, size), return_inverse=True)
            counts = np.bincount(which, weights=counts)
    for size, low in ((1, bigrams.ravel()), (0, bigrams.sum(0))):
        if low.any():
            levels[size] = Level(np.flatnonzero(low).astype(np.uint64), low[low > 0].astype(np.float64))
    n = len(asked)
    out, left, done = np.zeros(n), np.ones(n), np.zeros(n, bool)
    gone, gone_kinds = np.zeros(n), np.zeros(n)  # what the longer context has seen already
    for size in range(order, -1, -1):
        if size not in levels:
            continue
        level = levels[size]
        gram = _suffix(asked, size + 1)
        at, known = _find(level.contexts, gram >> np.uint64(8))
        total = np.where(known, level.total[at], 0) - gone
        kinds = np.where(known, level.kinds[at], 0) - gone_kinds
        whole = total + np.where(kinds + gone_kinds < 256, kinds, 0)  # no escape once every byte is known
        place, seen = _find(level.grams, gram)
        now = seen & ~done
        out[now] = left[now] * level.counts[place[now]] / whole[now]
        done |= now
        left = np.where(~done & (whole > 0), left * (whole - total) / np.maximum(whole, 1e-9), left)
        gone_kinds = np.where(known, level.kinds[at], 0)
        if size - 1 in levels:
            lower = levels[size - 1]
            below, _ = _find(lower.grams, _suffix(level.grams, size))
            gone = np.where(known, np.add.reduceat(lower.counts[below], level.first)[at], 0)
    out[~done] = left[~done] / np.maximum(1, 256 - gone_kinds[~done])
    return out


class BlockWords:
    """The distinct words of a block's texts by hash (an end of text is no word here), and their distinct byte grams."""

    def __init__(self, column: pa.Array, order: int) -> None:
        data, offsets = _common.string_parts(column)
        self.pieces = []
        hashes = []
        self.order = order
        for lo, hi in _common.byte_slices(offsets, SLICE_BYTES):
            piece, words = _words.split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _words.SPACE_WORD, lower=True)
            hashes.append(_words.hashes(piece, words))
            self.pieces.append((lo, hi, words.count))
        self.counts = np.concatenate([c for *_, c in self.pieces]) if self.pieces else np.zeros(0, np.int64)
        self.distinct, which = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True)
        self.which = which.astype(np.int32)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.data, self.offsets = data, offsets
        self.grams = _words.distinct(np.concatenate([_words.distinct(g) for _, g, _ in self.each_piece()]) if self.pieces else np.zeros(0, np.uint64))
        self.places = _words.Places(self.grams)

    def each_piece(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for lo, hi, _ in self.pieces:
            yield lo, *byte_grams(self.data[self.offsets[lo] : self.offsets[hi]], self.offsets[lo : hi + 1] - self.offsets[lo], self.order)

    def gram_counts(self, texts: np.ndarray) -> np.ndarray:
        """How often each of the grams is in the texts that the mask picks."""
        counts = np.zeros(len(self.grams), np.int64)
        for lo, grams, first in self.each_piece():
            picked = np.repeat(texts[lo : lo + len(first) - 1], np.diff(first))
            counts += np.bincount(self.places.of(grams[picked]), minlength=len(counts))
        return counts

    def asked(self, buckets: int) -> Iterator[tuple[str, int, np.ndarray]]:
        """(kind, bucket, indexes among the distinct words or grams) of each question."""
        for kind, bucket in (("word", _blocks.bucket_of(self.distinct, buckets)), ("gram", _blocks.bucket_of((self.grams >> np.uint64(8)) & np.uint64(0xFFFF), buckets))):
            by = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in range(buckets):
                if ends[b] < ends[b + 1]:
                    yield kind, b, by[ends[b] : ends[b + 1]]


def bigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of each byte (second index) after each (first) in all texts; 65,536 rows at most come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for part in _common.in_slices(batches, "text", SLICE_BYTES):
            total += np.bincount(byte_grams(*_common.string_parts(part.column("text")), 1)[0].astype(np.int64), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    sums = docs.select(_common.text_or_empty(text).alias("text")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(1 << 16, np.int64)
    found[sums["gram"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return found.reshape(256, 256)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", smooth: float = 0.1, order: int = ORDER) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Both models learn from the rows whose key's crc32 mod 10 isn't 0 (a null key is learned from). Null and empty texts
    are one end token. Repeated rows are counted and scored each; other columns are ignored; with no row to learn
    from, every byte is as likely as any other and no token is known; an empty table gives an empty result. Words are
    told apart by 64-bit hashes; score is exact to about seven digits.
    """
    rows, blocks = _blocks.in_blocks(docs, key, text)
    rows = rows.withColumn("held_out", held_out(F.col("key")))
    buckets = max(1, ceil(blocks * _blocks.BLOCK_BYTES / BUCKET_BYTES))
    kind = rows.schema["key"].dataType.simpleString()

    train_docs = docs.where(~held_out(F.col(key)))
    bigrams = bigram_counts(train_docs, text)
    n_train = int(bigrams[:, MARK].sum())  # ends of texts

    def ask(group: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = BlockWords(table.column("text").combine_chunks(), order)
        train = ~np.asarray(table.column("held_out").combine_chunks())
        own = {"word": (block.distinct, np.bincount(block.which[train[block.text]], minlength=len(block.distinct))), "gram": (block.grams, block.gram_counts(train))}
        found: dict[str, list] = {"kind": [], "block": [], "bucket": [], "keys": [], "counts": []}
        for what, b, which in block.asked(buckets):
            keys, counts = own[what]
            counts = counts[which]
            counts = counts.astype(np.int32 if counts.max() < 1 << 31 else np.int64)
            for name, value in zip(found, (what, group[0].as_py(), b, keys[which].tobytes(), counts.tobytes()), strict=True):
                found[name].append(value)
        return pa.table(found, pa.schema([("kind", pa.string()), ("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def answer(group: tuple, table: pa.Table) -> pa.Table:
        """Counts of the words, or logarithms of the grams' probabilities, in the order asked."""
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = [np.frombuffer(x, np.int32 if len(x) == 4 * len(k) else np.int64) for x, k in zip(table.column("counts").to_pylist(), keys, strict=True)]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, which, np.concatenate(counts))
        ends = np.cumsum([0, *map(len, keys)])
        words = group[0].as_py() == "word"
        if words:
            reply = total
        else:
            # all of a text's logarithms have one sign, so their sum is as exact as they are: to a part in 2**24
            reply = np.log10(probabilities(distinct, distinct[total > 0], total[total > 0].astype(np.float64), order, bigrams)).astype(np.float32)
        told = [reply[which[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        known, tokens = [0] * len(told), [0] * len(told)
        if words:
            known[0], tokens[0] = int((total > 0).sum()), int(total.sum())  # of the bucket
        return pa.table({"kind": table.column("kind"), "block": table.column("block"), "bucket": table.column("bucket"), "told": pa.array(told, pa.binary()), "known": pa.array(known, pa.int64()), "tokens": pa.array(tokens, pa.int64())})

    asked = rows.groupBy("block").applyInArrow(ask, "kind string, block int, bucket int, keys binary, counts binary")
    answers = _common.materialize(asked.groupBy("kind", "bucket").applyInArrow(answer, "kind string, block int, bucket int, told binary, known long, tokens long"), "answers")
    known, tokens = answers.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    total, kinds = tokens + n_train, known + (n_train > 0)

    def score(group: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = BlockWords(table.column("text").combine_chunks(), order)
        counts, logs = np.zeros(len(block.distinct), np.int64), np.zeros(len(block.grams))
        said = {(k, b): x for k, b, x in zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", "told")), strict=True)}
        for what, b, which in block.asked(buckets):
            if what == "word":
                counts[which] = np.frombuffer(said[what, b], np.int64)
            else:
                logs[which] = np.frombuffer(said[what, b], np.float32)
        scale = np.log10(total + smooth * (kinds + 1))
        n = len(block.counts)
        base = np.bincount(block.text, weights=np.log10(counts + smooth)[block.which], minlength=n) + np.log10(n_train + smooth) - (block.counts + 1) * scale
        known_words = np.bincount(block.text, weights=(counts > 0)[block.which], minlength=n).astype(np.int64) + int(n_train > 0)
        ppm = [np.add.reduceat(logs[block.places.of(grams)], first[:-1]) for _, grams, first in block.each_piece()]
        return pa.table({"key": table.column("key"), "held_out": table.column("held_out"), "n_tokens": pa.array(block.counts + 1, pa.int64()), "n_known": pa.array(known_words, pa.int64()), "base_score": pa.array(base), "score": pa.array(np.concatenate(ppm) if n else np.zeros(0))})

    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
