"""The words that the mix takes of each document, against a plain model that awards blocks one by one."""

from __future__ import annotations

import random
import struct
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, floor

import pytest
import xxhash

from corvane.llm import mixing
from tests.llm import brute
from tests.llm.conftest import SF


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def order_of(key: int, seed: int = mixing.SEED) -> int:
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)))


def filled(sizes: list[int], weights: list[int], most: int) -> list[Fraction]:
    """Shares by weight; what is above a source's limit is shared again until nothing is."""
    out: dict[int, Fraction] = {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in out]
        left = sum(sizes) - sum(out.values())
        share = {i: left * Fraction(weights[i], sum(weights[j] for j in rest)) for i in rest}
        over = [i for i in rest if share[i] > most * sizes[i]]
        if not over:
            return [out.get(i, share.get(i, Fraction(0))) for i in range(len(sizes))]
        out |= {i: Fraction(most * sizes[i]) for i in over}


def awarded(votes: list[Fraction], seats: int) -> list[int]:
    won = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        won[max(range(len(votes)), key=lambda i: (Fraction(votes[i]) / (2 * won[i] + 1), -i))] += 1
    return won


def model(rows: list[tuple], block: int, shard: int) -> Counter:
    sized = [(k, s, len(brute.SPACE_WORD.findall(t or ""))) for k, s, t in rows]
    names = sorted({s for _, s, _ in sized if s is not None}) + [None] * any(s is None for _, s, _ in sized)
    sizes = [sum(n for _, s, n in sized if s == name) for name in names]
    targets = filled(sizes, [1 + i % 3 for i in range(len(names))], mixing.MOST)
    quotas = awarded(targets, floor(sum(targets) / block + Fraction(1, 2)))
    out: Counter = Counter()
    for name, size, target, quota in zip(names, sizes, targets, quotas, strict=True):
        parts = max(1, ceil(size / shard))
        shards = defaultdict(list)
        for k, s, n in sized:
            if s == name:
                shards[order_of(k) % parts].append((order_of(k), k, n))
        votes = [Fraction(sum(n for _, _, n in shards[i])) for i in range(parts)]
        for i, blocks in enumerate(awarded(votes, quota)):
            held = int(votes[i])
            passes, rest = divmod(min(blocks * block, mixing.MOST * held), held) if held else (0, 0)
            for _, k, n in sorted(shards[i]):
                part = min(n, rest)
                rest -= part
                out[k, n, size, round(float(target), 6), passes * n + part] += 1
    return out


def found(df, **how) -> Counter:
    return Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(df, **how).collect())


@pytest.mark.parametrize("shard", [mixing.SHARD, 3000])
def test_taken_of_the_table(spark, shard):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    assert found(docs, shard=shard) == model(rows, mixing.BLOCK, shard)


@pytest.mark.parametrize("seed", range(4))
def test_taken_of_random_tables(spark, seed):
    rng = random.Random(seed)
    words = lambda: rng.choice([0, 1, 5, 40, 300])
    rows = [(i, rng.choice(["a", "b", "ü", None, "Z"][: 2 + seed]), rng.choice([None, "w " * words(), "x\ty " * words()])) for i in range(60)]
    assert found(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=7, shard=200) == model(rows, 7, 200)
