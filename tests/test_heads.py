"""Greedy heads against the loop over items in their order."""

from __future__ import annotations

import random

import pytest

from corvane.operators import heads


def loop(items, percent):
    chosen, out = [], {}
    for place, tokens in sorted(items):
        s = set(tokens or ())
        head = next((p for p, h in chosen if s and h and 100 * len(s & h) >= percent * len(s | h)), None)
        if head is None:
            chosen.append((place, s))
        out[place] = place if head is None else head
    return out


def chain(n, order):
    """Each resembles its neighbours only."""
    sets = [[f"w{i + j}" for j in range(8)] for i in range(0, 2 * n, 2)]
    return list(zip(order(range(n)), sets, strict=True))


def crowd(rng):
    base = [f"c{i}" for i in range(12)]
    near = [base[: i % 12] + base[i % 12 + 1 :] + [f"x{i}"] for i in range(120)]
    return list(enumerate(near + [base] * 20 + [[f"r{rng.randrange(30)}" for _ in range(rng.randrange(7))] for _ in range(150)] + [None, []]))


@pytest.mark.parametrize(("rounds", "small"), [(3, 200_000), (0, 0), (1, 5)])
def test_heads_equal_the_loop(spark, monkeypatch, rounds, small):
    monkeypatch.setattr(heads, "ROUNDS", rounds)
    monkeypatch.setattr(heads, "SMALL", small)
    rng = random.Random(rounds)
    shuffled = lambda r: rng.sample(list(r), len(r))
    cases = [(chain(24, list), 60), (chain(60, shuffled), 60), (crowd(rng), 60), ([(i, [rng.choice("abcdefg") for _ in range(rng.randrange(6))]) for i in shuffled(range(-60, 60))], 50)]
    for items, percent in cases[: 2 if small == 0 else 4]:
        found = heads.greedy_heads(spark.createDataFrame(items, "place long, tokens array<string>"), percent).collect()
        assert {r["place"]: r["head"] for r in found} == loop(items, percent) and len(found) == len(items)


def test_no_items(spark):
    none = spark.createDataFrame([], "place long, tokens array<string>")
    assert heads.greedy_heads(none).count() == 0 and heads.without_repeats(none).count() == 0


def test_pairs_that_cannot_be_similar_are_not_moved(spark, monkeypatch):
    """Sets of a small vocabulary meet by words without being similar."""
    rng, moved, similar = random.Random(7), [], heads._similar
    items = [(i, rng.sample([f"w{j}" for j in range(60)], 20)) for i in range(100)]
    monkeypatch.setattr(heads, "ROUNDS", 1)
    monkeypatch.setattr(heads, "_similar", lambda pairs, *x: (moved.append(pairs.count()), similar(pairs, *x))[1])
    found = heads.greedy_heads(spark.createDataFrame(items, "place long, tokens array<string>"), 60).collect()
    assert {r["place"]: r["head"] for r in found} == loop(items, 60) and sum(moved) < 100
