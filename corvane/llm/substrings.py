"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are dealt into blocks, and long ones count as segments. An index over all blocks, in buckets by hash, tells a
block for each sequence of ``window`` words that starts in its documents the least document, and the segment of it, in
which the sequence starts. These segments are the block's reference: they are fetched, their sequences and the block's
own are indexed by place, and each document is factored greedily against that index. At a place whose sequence is there
under a smaller key, the factor is the longest match from the indexed place on, word by word; else one word is passed.
A factor is a duplicate span. So are sequences that begin in a factor, run over its end and are in the index too, which
is checked at each boundary.

A block asks about each distinct sequence once, so a passage that very many documents share costs a bucket one entry a
block, and a long document is fetched only by the segments that are matched. The index goes by 64-bit hashes of the
sequences, matches by 64-bit hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _blocks, _common, _words

SLICE_BYTES = 1 << 20
#: Text bytes whose sequences make a bucket of the index, about.
BUCKET_BYTES = 12 << 20
#: Words of a segment.
SEGMENT = 4096
_LAST = np.iinfo(np.int64).max
_FACTORS = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("ref", pa.int64()), ("ref_at", pa.int32())]))


class Words:
    """The words of texts in one row, and the sequences of ``window`` words that start in them."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        data, offsets = _common.string_parts(texts)
        self.parts, hashes, sequences, at, counts = [], [], [], [], []
        done = 0
        for lo, hi in _common.byte_slices(offsets, SLICE_BYTES):
            piece = data[offsets[lo] : offsets[hi]]
            _, words = _words.split(piece, offsets[lo : hi + 1] - offsets[lo], _words.SPACE_WORD)
            hashes.append(_words.hashes(piece, words))
            starts = _words.starts_of(words, window)
            sequences.append(_words.windows(hashes[-1], window)[starts])
            at.append(starts + done)
            counts.append(words.count)
            self.parts.append((piece, words))
            done += len(words.start)
        none = np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.sequences = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
        self.at = np.concatenate(at) if at else none  #: the first word of each sequence
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else none)])  #: of each text, and the end
        self.text = np.searchsorted(self.first, self.at, side="right") - 1  #: of each sequence


class Block(Words):
    """A block's documents in the order of their keys, nulls last."""

    def __init__(self, table: pa.Table, window: int) -> None:
        table = table.combine_chunks()
        self.key = pa.array([], pa.int64())
        texts = pa.array([], pa.string())
        if table.num_rows:
            order = pa.compute.sort_indices(table, sort_keys=[("key", "ascending"), ("text", "ascending")], null_placement="at_end")
            self.key, texts = (table.column(c).combine_chunks().take(order) for c in ("key", "text"))
        super().__init__(texts, window)
        self.owner = np.asarray(self.key.fill_null(_LAST))[self.text] if table.num_rows else np.zeros(0, np.int64)

    def asked(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """By bucket the first places of the distinct sequences, in the order of places; the first is in the least key."""
        leader = np.sort(np.unique(self.sequences, return_index=True)[1])
        bucket = _blocks.bucket_of(self.sequences[leader], buckets)
        by = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield int(bucket[by[lo]]), leader[by[lo:hi]]


def _runs(*columns: np.ndarray) -> list[bytes]:
    """Rows in a row of equal ones, column by column, and their counts."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [*(c[at].tobytes() for c in columns), np.diff(np.append(at, n)).astype(np.int32).tobytes()]


def least_segments(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """(block, ref, segment): of ``rows`` (key, text, block), where sequences of a block start in a smaller document."""

    def ask(group: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, window)
        found: dict[str, list] = {"block": [], "bucket": [], "hashes": [], "ids": [], "segments": [], "counts": []}
        for b, which in block.asked(buckets):
            segment = ((block.at[which] - block.first[block.text[which]]) // SEGMENT).astype(np.int32)
            for name, value in zip(found, (group[0].as_py(), b, block.sequences[which].tobytes(), *_runs(block.owner[which], segment)), strict=True):
                found[name].append(value)
        return pa.table(found, pa.schema([("block", pa.int32()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("hashes", "ids", "segments", "counts"))]))

    def answer(group: tuple, table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        hashes, counts = read("hashes", np.uint64), read("counts", np.int32)
        h = np.concatenate(hashes)
        ids, segments = (np.concatenate([np.repeat(x, c) for x, c in zip(read(n, k), counts, strict=True)]) for n, k in (("ids", np.int64), ("segments", np.int32)))
        block = np.repeat(np.array(table.column("block").to_pylist(), np.int32), [len(x) for x in hashes])
        order = np.lexsort((segments, ids, h))
        begin = np.diff(h[order], prepend=~h[order[:1]]) != 0
        least = order[begin][np.cumsum(begin) - 1]  # of each place in the order
        copied = ids[least] < ids[order]
        asker, least = block[order[copied]], least[copied]
        refs = np.unique(np.stack([asker.astype(np.int64), ids[least], segments[least].astype(np.int64)]), axis=1)
        at = np.flatnonzero(np.diff(refs[0], prepend=-1, append=-1)).tolist()
        packed = [refs[1:, lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"block": pa.array(refs[0, at[:-1]], pa.int32()), "refs": pa.array(packed, pa.binary())})

    def gather(group: tuple, table: pa.Table) -> pa.Table:
        refs = np.unique(np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("refs").to_pylist()], axis=1), axis=1)
        return pa.table({"block": pa.array([group[0].as_py()] * refs.shape[1], pa.int32()), "ref": refs[0], "segment": pa.array(refs[1], pa.int32())})

    asked = rows.groupBy("block").applyInArrow(ask, "block int, bucket int, hashes binary, ids binary, segments binary, counts binary")
    answers = _blocks.dealt(asked, ceil(buckets / 4), "bucket").groupBy("bucket").applyInArrow(answer, "block int, refs binary")
    return answers.groupBy("block").applyInArrow(gather, "block int, ref long, segment int")


def _segments(docs: DataFrame, refs: DataFrame, window: int) -> DataFrame:
    """(block, ref, segment, words): the text of each segment in ``refs``, with the words that its last sequences run into."""
    bits, size = _common.key_filter(refs.select("ref").distinct())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = batch.filter(pa.array(_common.passes(bits, batch.column("slot").to_numpy())))
            for part in _common.in_slices(iter([picked]), "text", SLICE_BYTES):
                data, words = _words.split(*_common.string_parts(part.column("text")), _words.SPACE_WORD)
                raw, out = data.tobytes(), ([], [], [])
                for key, lo, hi in zip(part.column("key").to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    for k, at in enumerate(range(lo, max(lo, hi - window + 1), SEGMENT)):
                        until = min(at + SEGMENT + window - 1, hi) - 1
                        for column, value in zip(out, (key, k, raw[words.start[at] : words.end[until]].decode()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["ref", "segment", "words"])

    slots = docs.where("key IS NOT NULL").withColumn("slot", _common.slot("key", size))
    return refs.join(_common.bounded(slots).mapInArrow(cut, "ref long, segment int, words string"), ["ref", "segment"])


def factors(block: Block, refs: list[tuple[int, int]], reference: Words, window: int) -> tuple[list[list[tuple]], np.ndarray]:
    """The greedy factors (at, size, ref, ref_at) of each document, in words, and the mask of duplicate words.

    refs: (key, segment) of each text of ``reference``.
    """
    own = len(block.hashes)
    words = np.concatenate([block.hashes, reference.hashes])
    keys = np.array([k for k, _ in refs], np.int64)
    sequences = np.concatenate([block.sequences, reference.sequences])
    owner = np.concatenate([block.owner, keys[reference.text]])
    place = np.concatenate([block.at, reference.at + own])
    order = np.lexsort((place, owner, sequences))
    begin = np.diff(sequences[order], prepend=~sequences[order[:1]]) != 0
    least = np.empty(len(order), np.int64)
    least[order] = order[begin][np.cumsum(begin) - 1]
    least = least[: len(block.sequences)]
    hit = owner[least] < block.owner  # the index has the sequence under a smaller key
    at_hit, from_ = block.at[hit], place[least[hit]]
    out: list[list[tuple]] = [[] for _ in range(len(block.first) - 1)]
    steps = np.zeros(own + 1, np.int32)
    text = block.text[hit]
    i, n = 0, len(at_hit)
    while i < n:
        at, ref, doc = int(at_hit[i]), int(from_[i]), int(text[i])
        if ref < own:
            source = int(np.searchsorted(block.first, ref, side="right")) - 1
            end, key, ref_at = int(block.first[source + 1]), block.key[source].as_py(), ref - int(block.first[source])
        else:
            source = int(np.searchsorted(reference.first, ref - own, side="right")) - 1
            end, key = int(reference.first[source + 1]) + own, refs[source][0]
            ref_at = ref - own - int(reference.first[source]) + refs[source][1] * SEGMENT
        most = min(int(block.first[doc + 1]) - at, end - ref)
        size, step = window, 64
        while size < most:  # word by word, in growing strides
            differ = np.flatnonzero(words[at + size : at + min(size + step, most)] != words[ref + size : ref + min(size + step, most)])
            if len(differ):
                size += int(differ[0])
                break
            size, step = min(size + step, most), 2 * step
        last = out[doc][-1] if out[doc] else None
        begin_at = at - int(block.first[doc])
        if last and last[0] + last[1] == begin_at and last[2] == key and last[3] + last[1] == ref_at:  # on into the next segment
            out[doc][-1] = (last[0], last[1] + size, key, last[3])
        else:
            out[doc].append((begin_at, size, key, ref_at))
        steps[at] += 1
        steps[at + size] -= 1
        # sequences of the index that begin in the factor and run over its end
        i, j = (int(np.searchsorted(at_hit, at + size - d)) for d in (0, window - 1))
        if j < i:
            steps[at_hit[j]] += 1
            steps[at_hit[j:i] + window] -= 1
            steps[at_hit[j + 1 : i]] += 1
    return out, np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """(key, n_words, n_removed, kept, spans) for each row of ``docs``; key is an integer.

    A word is removed if ``window`` consecutive words with it in them also start in a document with a smaller key,
    judged on the input. kept: the other words joined by one space. spans: the factors as (at, size, ref, ref_at): size
    words from at on are those of document ref from ref_at on; all words of factors are removed, besides those of
    sequences that run over a factor's end. Null and empty texts have no words. Rows repeated with one key don't remove
    each other's words, and get a result each (ref_at may then be a place in any of the rows). A null key counts as
    larger than any other. Other columns are ignored; an empty table gives an empty result.
    """
    rows, blocks = _blocks.in_blocks(docs, key, text)
    rows = rows.withColumn("key", F.col("key").cast("long"))
    buckets = max(1, ceil(blocks * _blocks.BLOCK_BYTES / BUCKET_BYTES))
    refs = _common.materialize(least_segments(rows, window, buckets), "references")
    fetched = _segments(rows.select("key", "text"), refs, window)

    def parse(group: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(table, window)
        found = found.combine_chunks()
        refs = list(zip(found.column("ref").to_pylist(), found.column("segment").to_pylist(), strict=True))
        reference = Words(found.column("words").combine_chunks() if found.num_rows else pa.array([], pa.string()), window)
        spans, gone = factors(block, refs, reference, window)
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        done = 0
        for piece, words in block.parts:
            raw, mask = piece.tobytes(), gone[done : done + len(words.start)]
            done += len(words.start)
            starts, ends = words.start.tolist(), words.end.tolist()
            for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                out["n_words"].append(hi - lo)
                out["n_removed"].append(int(mask[lo:hi].sum()))
                out["kept"].append(b" ".join(raw[starts[j] : ends[j]] for j in (np.flatnonzero(~mask[lo:hi]) + lo).tolist()).decode())
        named = [[dict(zip(("at", "size", "ref", "ref_at"), f, strict=True)) for f in x] for x in spans]
        return pa.table({"key": block.key, **{n: pa.array(v, t) for (n, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.string()), strict=True)}, "spans": pa.array(named, _FACTORS)})

    parsed = rows.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(parse, "key long, n_words long, n_removed long, kept string, spans array<struct<at: int, size: int, ref: long, ref_at: int>>")
    return parsed.withColumnRenamed("key", key)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
