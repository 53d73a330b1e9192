"""N-gram Jaccard join by count-vector R-trees.

Each text is the set of its word shingles. Equal sets are one class, so copies cost one row each. Shingles are
hashed into groups, and a class is the point of its group counts: the overlap of two sets is at most the sum of
the coordinate minima, for points as for the boxes of an R-tree, and pairs that survive are verified on the sets.

Points of a hundred groups and more can't be cut up by space alone, so the trees stand on families that lose no
pair: sets of about s shingles that link differ in at most d(s) of them, so of d + 1 + q groups of shingles q + 1 at
least are the same, contents and all. Sets with more than q empty groups sign by their least d + 1 shingles too, of
which linked sets share one. The classes of like size that share a signature are a block, and the least of them leads it.

Each class first joins the family of the leader that it shares most signatures with; a family's tree is walked by its
members, survivors are verified on the spot, and links merge components as they are found, so that a family gives at
most a spanning forest and its trees skip what is already together. Blocks whose members then aren't in one component
are joined by their leaders in a second pass. A class's shingles move once in the first pass, and in the second once
for each open family it is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _blocks, _common, _words
from corvane.llm.components import components

SLICE_BYTES = 1 << 20
#: Groups of the count vectors.
GROUPS = 256
#: Points of a tree's leaf and leaves of an inner box.
FANOUT = 24
#: Members of a tree's half, and shingles of it; larger families are joined tile by tile.
TILE = 2048
TILE_SHINGLES = 1 << 20
#: Signatures that meet in a bucket, about.
BUCKET = 1_000_000


def shingle_sets(column: pa.Array, k: int, slices: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, text by text and sorted, and where each text's begin (and the end)."""
    data, words = _words.split(*_common.string_parts(column), _words.SPACE_WORD, lower=True)
    hashed = _words.hashes(data, words)
    at = _words.starts_of(words, k)
    owner = _words.text_of(words)[at]
    keys = _words.windows(hashed, k)[at]
    for size in range(1, k):  # texts of fewer words are one shingle
        short = np.flatnonzero(words.count == size)
        if len(short):
            owner = np.concatenate([owner, short])
            keys = np.concatenate([keys, _words.windows(hashed, size)[words.first[short]] ^ np.uint64(size)])
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    owner, keys = owner[fresh], keys[fresh]
    return keys, np.searchsorted(owner, np.arange(len(column) + 1))


class Sizes:
    """Size classes for a threshold of percent / 100: linked sets lie in the same class or in neighbours."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.bounds = np.array([1], np.int64)

    def _grow(self, n: int) -> None:
        bounds = self.bounds.tolist()
        while bounds[-1] <= n:
            bounds.append(bounds[-1] * 100 // self.percent + 1)
        self.bounds = np.array(bounds, np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        self._grow(int(n.max(initial=1)))
        return np.searchsorted(self.bounds, n, side="right") - 1

    def shape(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of class c: the differences d that a link allows its smaller set, its groups d + 1 + q, and q.

        q is above the number of empty groups that all but few sets of the class have. Classes without allowed
        differences have no groups: their sets link with equal ones only.
        """
        least, most = self.bounds[c], self.bounds[c + 1] - 1
        d = most * (100 - self.percent) // self.percent
        empty = (d + 2) * np.exp(-least / (d + 2))
        q = 1 + np.ceil(empty + 2 * np.sqrt(empty)).astype(np.int64)
        return d, np.where(d > 0, d + 1 + q, 0), q


def _signatures(keys: np.ndarray, first: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of each set, in its own size class and the next smaller one."""
    n = np.diff(first)
    cls = sizes.of(np.maximum(n, 1))
    spread = _words.mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    owners, found = [], []
    for below in (0, 1):
        c = np.maximum(cls - below, 0)
        d, g, q = sizes.shape(c)
        g = np.where((n > 0) & (cls >= below), g, 0)
        tag = _words.mix(c.astype(np.uint64) << np.uint64(32))
        base = np.concatenate([[0], np.cumsum(g)])
        owner = np.repeat(np.arange(len(n)), n)
        used = g[owner] > 0
        owner, value = owner[used], spread[used]
        slot = base[owner] + (value % np.maximum(g, 1)[owner].astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, slot, _words.mix(value))
        full = np.bincount(slot, minlength=base[-1]) > 0
        who = np.repeat(np.arange(len(n)), g)
        inner = (np.arange(base[-1]) - base[who]).astype(np.uint64)
        owners.append(who[full])
        found.append(_words.mix(total + tag[who] + _words.mix(inner))[full])
        sparse = np.bincount(who, weights=~full, minlength=len(n)) > q
        if (sparse & (g > 0)).any():
            mine = sparse[owner]
            owner, value = owner[mine], value[mine]
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            least = rank <= d[owner]
            owners.append(owner[least])
            found.append(_words.mix(value[least] + tag[owner[least]] + np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(owners), np.concatenate(found)


_SALTS = (0x51ED270B5, 0xD1B54A32D192ED03)


def _set_hash(keys: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    total = np.zeros(len(first) - 1, np.uint64)
    np.add.at(total, np.repeat(np.arange(len(first) - 1), np.diff(first)), _words.mix(keys + np.uint64(salt)))
    return total


def describe(docs: DataFrame, k: int) -> DataFrame:
    """(key, n, h1, h2) of each row of ``docs`` (key, text): size and two set hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _common.in_slices(batches, "text", SLICE_BYTES):
            keys, first = shingle_sets(part.column("text"), k)
            h1, h2 = (_set_hash(keys, first, salt).view(np.int64) for salt in _SALTS)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(first), pa.int64()), pa.array(h1), pa.array(h2)], names=["key", "n", "h1", "h2"])

    return _common.bounded(docs).mapInArrow(sets, f"key {docs.schema['key'].dataType.simpleString()}, n long, h1 long, h2 long")


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``values`` up to each end, as bytes."""
    size = values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.concatenate([[0], ends]) * size).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All values of a column of packed runs, in order."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist() if x)])


def shared_signatures(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """(sig, h1, lead): the signatures that differing sets share, their sets, and for each a set to be held against.

    Signatures go to their bucket slice by slice, packed. Where several sets of a slice share one, only the least of
    them goes there, and leads the others; so a group of very many near copies costs a bucket one entry a slice.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(percent)
        for part in _common.in_slices(batches, "text", 3 * SLICE_BYTES):
            keys, first = shingle_sets(part.column("text"), k)
            owner, sig = _signatures(keys, first, sizes)
            own = _set_hash(keys, first, _SALTS[0]).view(np.int64)[owner]
            order = np.lexsort((own, sig))
            own, sig = own[order], sig[order]
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])  # copies within the slice count once
            own, sig = own[fresh], sig[fresh]
            begin = np.ones(len(sig), bool)
            begin[1:] = sig[1:] != sig[:-1]
            run = np.cumsum(begin) - 1
            many = np.bincount(run)[run] > 1 if len(run) else begin
            lead = own[begin][run] if len(run) else own
            bucket = _blocks.bucket_of(sig[begin], buckets)
            by = np.lexsort((own[begin], bucket))
            at = np.flatnonzero(np.concatenate([bucket[by][1:] != bucket[by][:-1], [True]])) + 1 if len(by) else np.zeros(0, np.int64)
            columns = [pa.array(bucket[by][at - 1], pa.int64()), _packed(sig[begin][by], at), _packed(own[begin][by], at), pa.array([b""] * len(at), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "sigs", "owners", "known"])
            if many.any():
                rows = np.stack([sig[many].view(np.int64), own[many], lead[many]])  # the led sets and their leaders are known to share
                near = int(own[0]) % buckets
                yield pa.RecordBatch.from_arrays([pa.array([near], pa.int64()), *(pa.array([x], pa.binary()) for x in (b"", b"", rows.tobytes()))], names=["bucket", "sigs", "owners", "known"])

    def meet(group: tuple, packed: pa.Table) -> pa.Table:
        known = [np.frombuffer(x, np.int64).reshape(3, -1) for x in packed.column("known").to_pylist() if x]
        sig, own = (_unpacked(packed.column(c), np.int64) for c in ("sigs", "owners"))
        if len(sig):
            order = np.argsort(sig, kind="stable")
            sig, own = sig[order], own[order]
            begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.append(begin, len(sig)))
            least, most = (np.repeat(f.reduceat(own, begin), size) for f in (np.minimum, np.maximum))
            shared = least != most
            known.append(np.stack([sig[shared], own[shared], least[shared]]))
        rows = np.concatenate([np.zeros((3, 0), np.int64), *known], axis=1)
        return pa.table({"sig": rows[0], "h1": rows[1], "lead": rows[2]})

    packed = _common.bounded(docs).mapInArrow(pack, "bucket long, sigs binary, owners binary, known binary")
    return _blocks.dealt(packed, buckets, "bucket").groupBy("bucket").applyInArrow(meet, "sig long, h1 long, lead long")


def _may_link(shared: np.ndarray, n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n1 + n2 - shared)


class RTree:
    """Points packed by size and leading counts into leaves, leaves into boxes; a box has its coordinates' maxima."""

    def __init__(self, counts: np.ndarray, n: np.ndarray, component: np.ndarray, percent: int) -> None:
        self.percent = percent
        self.order = np.lexsort((*counts[:, :3].T, n))
        self.points, self.n, self.component = counts[self.order], n[self.order], component[self.order]
        self.levels = []  # from the leaves up: (maxima, least size, largest size, component or -1)
        high, lo, up, comp = self.points, self.n, self.n, self.component
        while len(high) > FANOUT or not self.levels:
            at = np.arange(0, len(high), FANOUT)
            same = np.minimum.reduceat(comp, at) == np.maximum.reduceat(comp, at)
            comp = np.where(same, np.minimum.reduceat(comp, at), -1)
            high, lo, up = np.maximum.reduceat(high, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(up, at)
            self.levels.append((high, lo, up, comp))

    def seek(self, q: np.ndarray, n: int, component: int) -> np.ndarray:
        """Positions of points outside ``component`` whose overlap with q may be large enough."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, lo, up, comp = (x[at] for x in self.levels[depth])
            most = np.minimum(high, q).sum(1, dtype=np.int64)
            # the best that a box can hold: overlap ``most``, in a set no smaller than that or than the box's least
            fits = _may_link(most, n, np.maximum(lo, most), self.percent) & (100 * up >= self.percent * n) & (self.percent * lo <= 100 * n) & (comp != component)
            at = at[fits]
            size = len(self.levels[depth - 1][0]) if depth else len(self.points)
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < size]
            if not len(at):
                return at
        fits = _may_link(np.minimum(self.points[at], q).sum(1, dtype=np.int64), n, self.n[at], self.percent) & (self.component[at] != component)
        return self.order[at[fits]]


def _overlaps(seeker: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the other sets has in common with the seeker's."""
    ends = np.cumsum([0, *map(len, others)])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(seeker, every), len(seeker) - 1)
    return np.add.reduceat((seeker[at] == every).astype(np.int64), ends[:-1])


def forest(sets: list[np.ndarray], component: np.ndarray, percent: int, half: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (positions) between sets of different components, as many as it takes to join what links.

    half: where given, only sets of different halves are held against each other.
    """
    m, n = len(sets), np.array([len(x) for x in sets], np.int64)
    component = np.unique(component, return_inverse=True)[1]
    group = (_words.mix(np.concatenate(sets)) % np.uint64(GROUPS)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(m), n) * GROUPS + group, minlength=m * GROUPS).reshape(m, GROUPS)
    counts = counts.astype(np.uint8 if counts.max() < 1 << 8 else np.uint16 if counts.max() < 1 << 16 else np.uint32)
    tree, merged, links = RTree(counts, n, component, percent), 0, []
    left = len(np.unique(component))
    for i in range(m):
        if left == 1:
            break
        if merged > left:  # the tree's boxes learn what has been joined since
            tree, merged = RTree(counts, n, component, percent), 0
        near = tree.seek(counts[i], n[i], component[i])
        near = near[(near > i) & (component[near] != component[i])]
        if half is not None:
            near = near[half[near] != half[i]]
        if not len(near):
            continue
        shared = _overlaps(sets[i], [sets[j] for j in near.tolist()])
        for j in near[(shared > 0) & (100 * shared >= percent * (n[i] + n[near] - shared))].tolist():
            if component[j] != component[i]:
                links.append((i, j))
                component[component == component[j]] = component[i]
                merged, left = merged + 1, left - 1
    return links


def _join(members: DataFrame, sets: DataFrame, bins: int, percent: int) -> DataFrame:
    """(a, b): links within the tiles of ``members`` (family, i, j, half, h1, component); small families share a bin."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tile = np.stack([table.column(c).to_numpy() for c in ("family", "i", "j", "h1")])
        order = np.lexsort(tile[::-1])
        tile = tile[:, order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (tile[:, 1:] != tile[:, :-1]).any(0)  # rows repeated with one key repeat their sets
        order, tile = order[fresh], tile[:, fresh]
        component, half = (table.column(c).to_numpy()[order] for c in ("component", "half"))
        packed = table.column("shingles").combine_chunks()
        begin = np.flatnonzero(np.concatenate([[True], (tile[:3, 1:] != tile[:3, :-1]).any(0)]))
        a, b = [], []
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
            found = [np.frombuffer(packed[at].as_buffer(), np.uint64) for at in order[lo:hi].tolist()]
            across = half[lo:hi] if tile[1, lo] != tile[2, lo] else None
            for x, y in forest(found, component[lo:hi], percent, across) if hi - lo > 1 else ():
                a.append(int(tile[3, lo + x]))
                b.append(int(tile[3, lo + y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = members.join(sets, "h1").withColumn("bin", F.when(F.col("alone"), F.xxhash64("family", "i", "j")).otherwise(F.pmod(F.xxhash64("family"), F.lit(bins)))).drop("alone")
    return _common.materialize(_blocks.dealt(rows, bins, "bin").groupBy("bin").applyInArrow(join, "a long, b long"), "links")


def _tiled(members: DataFrame, sizes: DataFrame, star: bool) -> tuple[DataFrame, int, DataFrame]:
    """``members`` (family, h1, component) dealt to tiles, the number of bins for the small families, and the large ones.

    A family of more than a tile goes by chunks: with ``star`` each chunk with the leader, else each with every other.
    """
    sized = members.join(sizes, "h1")
    chunks = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    large = _common.materialize(sized.groupBy("family").agg(chunks.alias("chunks")).where("chunks > 1"), "large")
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = sized.join(large, "family", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("half", F.pmod(F.xxhash64("h1"), "chunks").cast("int"))
    every = F.expr("sequence(0, chunks - 1)")
    if star:
        rows = rows.withColumn("i", F.explode(F.when(F.col("h1") == F.col("family"), every).otherwise(F.array("half")))).withColumn("j", F.col("i"))
    else:
        rows = rows.withColumn("x", F.explode(every)).withColumn("i", F.least("half", "x")).withColumn("j", F.greatest("half", "x"))
    return rows.select("family", "i", "j", "half", "h1", "component", (F.col("chunks") > 1).alias("alone")), max(1, ceil(total / TILE_SHINGLES)), large


def _shingles(source: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """(h1, shingles): the packed sets of the texts whose key is in ``need``; some others, too many for its filter, come along."""
    bits, size = _common.key_filter(need)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = batch.filter(pa.array(_common.passes(bits, batch.column("slot").to_numpy())))
            for part in _common.in_slices(iter([picked]), "text", SLICE_BYTES):
                keys, first = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([pa.array(_set_hash(keys, first, _SALTS[0]).view(np.int64)), _packed(keys, first[1:])], names=["h1", "shingles"])

    slots = source.where(F.col("key").isNotNull()).select("text", _common.slot("key", size).alias("slot"))
    return _common.bounded(slots).mapInArrow(pack, "h1 long, shingles binary")


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``.

    A text is the set of its distinct shingles of lower-cased (A-Z) words; with fewer words, all of them are one
    shingle. Rows link when 100 * intersection >= percent * union; component_id is the smallest key that links
    reach. Null and empty texts, and texts without words, have no shingle and are alone; a null key links with
    nothing and has a null component. Rows repeated with one key get a result each. Other columns are ignored; an
    empty table gives an empty result. Shingles, and sets in links, are told apart by 64-bit hashes.
    """
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("key"), _common.text_or_empty(text).alias("text"))
    rows = _common.materialize(describe(source, shingle), "sets")
    usable = rows.where((F.col("n") > 0) & F.col("key").isNotNull())
    classes = _common.materialize(usable.groupBy("n", "h1", "h2").agg(F.min("key").alias("rep")), "classes")

    total = usable.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, ceil(2.2 * total * (100 - percent) / percent / BUCKET))
    blocks = _common.materialize(shared_signatures(source.where(F.col("key").isNotNull()), shingle, percent, buckets), "blocks")
    _common.discard(spark)

    # each class with the leader that it shares most signatures with, the least of equal ones
    best = blocks.where("h1 != lead").groupBy("h1", "lead").agg(F.count("*").alias("often")).groupBy("h1").agg(F.max_by("lead", F.struct("often", F.bitwise_not("lead"))).alias("family"))
    best = _common.materialize(best, "families")
    sizes = classes.select("h1", "n", "rep").join(blocks.select("h1").distinct(), "h1")
    sizes = _common.materialize(sizes, "members")
    sets = _common.materialize(_shingles(source, sizes.select(F.col("rep").alias("key")), shingle), "shingles")
    _common.discard(spark)
    sizes = sizes.select("h1", "n")
    members = best.unionByName(best.select(F.col("family").alias("h1"), "family").distinct()).withColumn("component", F.col("h1"))
    tiles, bins, large = _tiled(members, sizes, star=True)
    links = _join(tiles, sets, bins, percent)
    known = components(links)

    # blocks that are not yet in one component, by their leaders
    placed = blocks.select("sig", "h1").distinct().join(known.withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    open_ = placed.groupBy("sig").agg(F.min("h1").alias("family"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("sig", "family")
    again = placed.join(open_, "sig").select("family", "h1", "component").distinct().join(best.withColumnRenamed("family", "tried"), "h1", "left")
    again = _common.materialize(again.withColumn("new", (F.col("h1") != F.col("family")) & ~F.col("tried").eqNullSafe(F.col("family"))), "open")
    # all pairs of a family that was one tile in the first pass have been tried
    wide = again.groupBy("family").agg(F.max("new").alias("new")).join(large.withColumn("cut", F.lit(True)), "family", "left").where("new OR cut").select("family")
    tiles, bins, _ = _tiled(again.join(wide, "family").select("family", "h1", "component"), sizes, star=False)
    more = _join(tiles, sets, bins, percent)
    found = components(links.unionByName(more))
    _common.discard(spark, blocks, best, sets, again)

    named = classes.select("n", "h1", "h2", "rep").join(found.withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("n", "h1", "h2", "least")
    of_row = rows.join(named, ["n", "h1", "h2"], "left")
    own = F.when(F.col("n") == 0, F.col("key")).when(F.col("key").isNotNull(), F.col("least"))
    return of_row.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=90)
