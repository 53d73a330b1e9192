"""SimHash groups, conversation repair and periodic runs against plain twins, on the small tables and on odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import dialogue, runs, simhash
from tests.llm import brute
from tests.llm.conftest import SF
from tests.llm.test_operators import docs, empty, odd, pairs, same  # noqa: F401  fixtures


def hexed(df):
    return df.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))).select("doc_id", "fingerprint", "component_id").collect()


def test_simhash(spark, docs, odd, empty):  # noqa: F811
    same(simhash.op11_simhash(spark, SF).collect(), brute.simhash(pairs(docs)))
    same(hexed(simhash.simhash_groups(odd)), brute.simhash(pairs(odd)))
    same(hexed(simhash.simhash_groups(odd, shingle=1, bits=1)), brute.simhash(pairs(odd), 1, 1))
    assert simhash.simhash_groups(empty).count() == 0


def test_fingerprints_of_cut_texts(monkeypatch):
    """Pieces of a text and parts of a slice change nothing."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Äb", "c", "DEF", "\t", "g" * 40]) for _ in range(rng.randrange(90))).encode() for _ in range(60)]
    wanted = [int(p, 16) for _, p, _ in brute.simhash([(i, t.decode()) for i, t in enumerate(texts)])]
    for piece, part in ((4 << 20, 1 << 14), (16, 7)):
        monkeypatch.setattr(simhash, "PIECE_BYTES", piece)
        monkeypatch.setattr(simhash, "UNPACKED", part)
        assert simhash.fingerprints_of(texts, 3).tolist() == wanted


@pytest.mark.parametrize("small", [2, 64])
@pytest.mark.parametrize("bits", [1, 2])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, bits, small):
    """Crowded neighbourhoods: chains of flipped bits, in lists of both kinds."""
    monkeypatch.setattr(simhash, "SMALL_LIST", small)
    rng = random.Random(bits)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << b
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "p long"), bits).collect()}
    assert all((a ^ b).bit_count() <= bits for a, b in found)

    def grouped(edges):
        label = {p: p for p in prints}
        for _ in prints:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert grouped(found) == grouped([(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= bits])


def report(rows):
    return dialogue.repair_report(rows, dialogue.plan_repair(rows), rows)


def random_turns(rng, conversations, most):
    texts = ["Yes.", "No", "", " ", None, "Why?", "So!\n", "... ", "Yes."]
    rows = []
    for c in range(conversations):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user"], ["assistant", "system", "tool", "", None, "ufo"]])
        for _ in range(rng.randrange(most)):
            turn = rng.choice([None, *range(6)]) if rng.random() < 0.5 else len(rows) % 40
            rows += [(rng.choice([c, c, c, None]), turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{len(rows)}{rng.choice(['.', ''])}")] * rng.choice([1, 1, 1, 2])
    return rows


TURNS = "conv_id long, turn long, role string, text string"


def test_repair_of_random_conversations(spark):
    rows = random_turns(random.Random(11), 300, 9)
    same(report(spark.createDataFrame(rows, TURNS).withColumn("at", F.lit(1)).withColumn("block", F.lit("x"))).collect(), brute.repairs(rows, [r[0] for r in rows]))


def test_repair_over_many_blocks(spark, monkeypatch):
    """Conversations that lie in many blocks, of which one has most rows."""
    monkeypatch.setattr(dialogue, "BLOCK_ROWS", 7)
    rows = [(1 if random.Random(i).random() < 0.6 else r[0], i % 60, r[2], r[3]) for i, r in enumerate(random_turns(random.Random(4), 60, 9))]
    df = spark.createDataFrame(rows, TURNS)
    assert dialogue._shared_ends(dialogue._blocks(dialogue._turns(df))).count() > 20
    same(report(df).collect(), brute.repairs(rows, [r[0] for r in rows]))


def test_repaired_turns_have_the_form(spark):
    rows = spark.createDataFrame(random_turns(random.Random(5), 120, 12), TURNS)
    plan = dialogue.plan_repair(rows)
    by: dict = {}
    for r in dialogue.repaired_turns(rows, plan).orderBy("at", "step").collect():
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    reported = {r["conv_id"]: r["repaired_sha256"] for r in dialogue.repair_report(rows, plan, rows).collect()}
    for conv, turns in by.items():
        initials = "".join(role[:1] for role, _ in turns).removeprefix("s")
        assert initials and initials == "ua" * (len(initials) // 2)
        assert brute.sha256("\n".join(f"{role}:{text}" for role, text in turns)) == reported[conv]
    assert all(sha == brute.sha256("") for conv, sha in reported.items() if conv not in by)


def test_conversation_repair_of_the_table(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(dialogue.op12_conversation_repair(spark, SF).collect(), brute.repairs(brute.damaged(given), [r[0] for r in given]))


def test_repair_of_damaged_odd_rows(spark):
    rows = random_turns(random.Random(8), 90, 8)
    df = dialogue.damaged(spark.createDataFrame(rows, TURNS))
    same([tuple(r) for r in df.collect()], brute.damaged(rows))
    found = dialogue.repair_report(df, dialogue.plan_repair(df), spark.createDataFrame(rows, TURNS))
    same(found.collect(), brute.repairs(brute.damaged(rows), [r[0] for r in rows]))
    none = spark.createDataFrame([], TURNS)
    assert report(none).count() == 0 and dialogue.repaired_turns(none, dialogue.plan_repair(none)).count() == 0


def test_periodic_runs(spark, docs):  # noqa: F811
    same(runs.op13_periodic_runs(spark, SF).collect(), brute.periodic(pairs(docs)))


def test_runs_of_odd_rows(spark, odd, empty):  # noqa: F811
    rows = pairs(odd)
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(odd).collect()]
    wanted = []
    for key, text in rows:
        words = brute.SPACE_WORD.findall(text or "")
        listed = brute.runs(words) if len(words) < 5000 else []  # the long ones repeat with a period of 997 * 13, not four times
        gone = {i for s, length, q in listed for i in range(s + q, s + length)}
        wanted.append((key, len(words), listed, " ".join(w for i, w in enumerate(words) if i not in gone)))
    strip = lambda xs: sorted(map(repr, xs))
    long = [r for r in found if r[1] >= 5000]
    assert strip(r for r in found if r[1] < 5000) == strip(r for r in wanted if r[1] < 5000)
    assert len(long) == 2 and all(r[1] == len(r[3].split()) for r in long if not r[2])
    assert runs.find_runs(empty).count() == 0 and runs.with_planted_periods(empty).count() == 0


@pytest.mark.parametrize(("shortest", "times"), [(6, 4), (2, 2), (5, 3)])
def test_runs_of_random_words(shortest, times):
    rng = random.Random(times)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 4)):
            words = [str(rng.randrange(rng.choice([1, 2, 3, 5]))) for _ in range(rng.randrange(50))]
            if words and rng.random() < 0.5:
                a, p = rng.randrange(len(words)), rng.randrange(1, 8)
                words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
            texts.append(words)
        base = np.cumsum([0] + [len(t) for t in texts])
        found = runs.runs_of(np.array([int(w) * 7919 + 13 for t in texts for w in t], np.uint64), np.repeat(np.arange(len(texts)), np.diff(base)), shortest, times)
        wanted = [(s + int(base[k]), length, q) for k, t in enumerate(texts) for s, length, q in brute.runs(t, shortest, times)]
        assert list(zip(*(x.tolist() for x in found), strict=True)) == wanted


def test_long_run_is_parsed_whole():
    words = np.tile(np.arange(1, 1001, dtype=np.uint64), 60)
    found = runs.runs_of(words, np.zeros(len(words), np.int64))
    assert [x.tolist() for x in found] == [[0], [60_000], [1000]]
