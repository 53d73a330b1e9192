"""Interval joins, capped two-step search, heading levels and filters against plain models."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, index, sheets
from corvane.plans.question_queries import node_types
from corvane.plans.retrieval_queries import fusion
from corvane.plans.sheet_queries import kept_questions, nine_rules, question_clusters
from tests.test_heads import loop

SF = "/root/testdata/sf0.001"


def test_within_ranges(spark):
    rng = random.Random(1)
    points = [(i, rng.choice([None, -3, 0, 255, 256, rng.randrange(256)])) for i in range(300)]
    ranges = [(i, *rng.choice([(0, 255), (7, 7), (9, 3), (-5, 4), (200, 900), (None, 4)] + [tuple(sorted(rng.sample(range(256), 2)))] * 6)) for i in range(120)]
    found = index.within_ranges(spark.createDataFrame(points, "p int, x int"), spark.createDataFrame(ranges, "r int, lo int, hi int"), "x", "lo", "hi", bits=8)
    assert Counter((r["p"], r["r"]) for r in found.collect()) == Counter((p, r) for p, x in points for r, lo, hi in ranges if x is not None and 0 <= x <= 255 and lo is not None and lo <= x <= hi)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_range_totals_make_no_pairs(spark):
    rng = random.Random(4)
    points = [(i, rng.choice([None, -3, 0, 255, 256, rng.randrange(256)])) for i in range(300)]
    ranges = [(i, *rng.choice([(0, 255), (7, 7), (9, 3), (-5, 4), (200, 900), (None, 4)] + [tuple(sorted(rng.sample(range(256), 2)))] * 6)) for i in range(120)]
    wanted = {p: (len(held), min(held)) for p, x in points if x is not None and 0 <= x <= 255 and (held := [r for r, lo, hi in ranges if lo is not None and lo <= x <= hi])}
    found = index.range_totals(spark.createDataFrame(points, "p int, x int"), spark.createDataFrame(ranges, "r int, lo int, hi int"), "x", "lo", "hi", "r", bits=8)
    assert {r["p"]: (r["n"], r["least"]) for r in found.collect()} == wanted
    # 800 million pairs, of which none is made
    many = index.range_totals(spark.range(20_000).selectExpr("id AS p", "id % 5 AS x"), spark.range(40_000).selectExpr("id AS r", "0 AS lo", "9 AS hi"), "x", "lo", "hi", "r")
    assert many.agg(F.count("*"), F.min("n"), F.max("n"), F.max("least")).first() == (20_000, 40_000, 40_000, 0)


def test_two_steps_around_a_hub(spark):
    rng = random.Random(2)
    names = [f"n{i:03}" for i in range(120)]
    edges = {("hub", n) for n in names} | {(n, "hub") for n in names[:40]} | {tuple(rng.sample(names, 2)) for _ in range(150)} | {("n001", "n001")}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    wanted = set()
    for s in [*names, "hub"]:
        one = out[s] - {s}
        two = set().union(*(out[m] for m in one)) - one - {s}
        wanted |= {(s, n, d) for n, d in (sorted((n, 1) for n in one) + sorted((n, 2) for n in two))[:9]}
    starts = spark.createDataFrame([(n, n) for n in [*names, "hub"]], "origin string, node_id string")
    found = graph.within_two(starts, spark.createDataFrame([(a, b, "r") for a, b in edges], "src string, dst string, relation string"), visits=9)
    assert {tuple(r) for r in found.select("origin", "node_id", "depth").collect()} == wanted


def test_heading_levels_by_hand(spark):
    sizes = {"a": [10.0] * 12 + [15.0, 14.6, 13.5, 11.4, 11.5], "b": [9.0] * 3 + [12.0] * 3 + [13.0, 13.5], "c": [8.0]}
    found = sheets.heading_levels(spark.createDataFrame([(d, s) for d, xs in sizes.items() for s in xs] + [("d", None)], "doc string, size double"))
    assert {(r["doc"], r["size"], r["level"]) for r in found.collect()} == {("a", 15.0, 1), ("a", 14.6, 1), ("a", 13.5, 2), ("a", 11.5, 3), ("b", 12.0, 2), ("b", 13.0, 1), ("b", 13.5, 1)}


def test_department_of_a_filter(spark):
    chunks = spark.createDataFrame([(1, "x", "", "SW"), (2, "x", "", None), (3, "x", "1", "EN")], "id int, doc_type string, semester string, department string").withColumns({"cohort_from": F.lit(2016), "cohort_to": F.lit(2030)})
    none = F.lit(None).cast("string")
    ids = lambda department: {r["id"] for r in chunks.where(index.metadata_filter(F.lit("2020"), F.array(F.lit("x")), none, department)).collect()}
    assert ids(None) == ids(F.lit("")) == ids(none) == {1, 2, 3} and ids(F.lit("SW")) == {1}


def test_question_clusters_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect()
    words = lambda t: t.split("\n", 1)[0].lower().split()
    heads = loop([(r["doc_id"], words(r["text"])) for r in docs], 60)
    found = {r["head"]: r for r in question_clusters(spark, SF).collect()}
    assert {h: r["n"] for h, r in found.items()} == Counter(heads.values())
    line = {r["doc_id"]: r["text"].split("\n", 1)[0] for r in docs}
    for h, r in found.items():
        inside = [d for d in heads if heads[d] == h]
        assert r["representative"] == line[min(inside, key=lambda d: (-len(line[d]), d))]
        assert r["examples"] == [line[d] for d in sorted(inside, key=lambda d: (-(d % 97), d))[:3]]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").collect()
    both = loop([(2 * r["item_id"], r["text"].lower().split()) for r in items] + [(2 * r["doc_id"] + 1, words(r["text"])) for r in docs], 60)
    assert {r["place"] for r in kept_questions(spark, SF).collect()} == {p for p, h in both.items() if p == h}


def test_node_types_analyse_a_question_once(spark):
    found = node_types(spark, SF)
    assert "Filter" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert len(rows) > 100 and all(r["node_types"] for r in rows)


def test_tagged_edges_are_not_moved(spark):
    tagged = [("a", ["x", "y"]), ("b", ["y"]), ("c", []), ("d", ["z"]), ("a", ["x"])]
    nodes = [(f"n{i:02}", "pqr"[i % 3]) for i in range(40)] + [("n00", "q"), ("n01", "q"), ("n02", None), (None, "p")]
    edges = [("a", "n00", "r"), ("a", "n03", "r"), ("b", "n01", "r"), ("b", "n99", "r"), ("d", "n00", "r")]
    types = {"x": {"p"}, "y": {"q"}, "z": set()}
    wanted = {(s, n, "T") for s, tags in tagged for t in tags for n, k in nodes if n and k in types[t]} - {(s, n, "T") for s, n, _ in edges}
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((tagged, "node_id string, tags array<string>"), ([("x", "p"), ("y", "q")], "tag string, node_type string"), (nodes, "node_id string, node_type string"), (edges, "src string, dst string, relation string"))]
    found = graph.tagged_edges(*frames, "T", part=5)
    rows = list(map(tuple, found.collect()))
    assert len(rows) == len(set(rows)) and set(rows) == wanted
    assert found._jdf.queryExecution().optimizedPlan().toString().splitlines()[1].startswith("+- Generate explode") or found._jdf.queryExecution().optimizedPlan().toString().splitlines()[0].startswith("Generate explode")


@pytest.mark.parametrize("sent", [0, 1000])
@pytest.mark.parametrize("task_parts", [1, 50_000])
def test_tagged_edges_of_many_parts(spark, monkeypatch, sent, task_parts):
    monkeypatch.setattr(graph, "SENT_TARGETS", sent)
    monkeypatch.setattr(graph, "TASK_PARTS", task_parts)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rng = random.Random(9)
    nodes = [(f"n{i:03}", "pq"[i % 2]) for i in range(150)] + [("n000", "q"), ("n003", "p"), ("n004", "w")]
    tagged = [(f"s{i}", ["x", "y"][: i % 3]) for i in range(12)] + [("s1", ["y"])]
    edges = [(f"s{i}", f"n{rng.randrange(150):03}", "r") for i in range(12) for _ in range((0, 3, 40, 149)[i % 4])] + [("s5", f"n{i:03}", "r") for i in range(150)] + [("zz", "n001", "r"), (None, "n001", "r")]
    types = {"x": "p", "y": "q"}
    wanted = {(s, n, "T") for s, tags in tagged for t in tags for n, k in nodes if k == types[t]} - {(s, n, "T") for s, n, _ in edges}
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((tagged, "node_id string, tags array<string>"), (list(types.items()), "tag string, node_type string"), (nodes, "node_id string, node_type string"), (edges, "src string, dst string, relation string"))]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if tables were large
        found = graph.tagged_edges(*frames, "T", part=4)
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        rows = list(map(tuple, found.collect()))
        assert len(rows) == len(set(rows)) and set(rows) == wanted
        # what lies above the step that makes a row for each source and part
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        at, above = next(i for i, line in enumerate(lines) if "Generate explode" in line and "sequence(" in line), []
        for line in reversed(lines[: at + 1]):
            if not above or depth(line) < depth(above[-1]):
                above.append(line)
        assert bool(sent) != any("Exchange" in line for line in above)
        assert len(above) > 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_sum_halfway_between_digits(spark, tmp_path):
    rng = random.Random(5)
    while True:  # prices of 12350.00 in all, whose doubles add up to less
        cents = [rng.randrange(100_000, 400_000) for _ in range(3)]
        prices = [c / 100 for c in [*cents, 1_235_000 - sum(cents)]]
        if sum(prices) < 12350:
            break
    spark.createDataFrame([(3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(3, p) for p in prices], "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    told = {r["type"]: r["description"] for r in nine_rules(spark, str(tmp_path)).collect()}
    assert told["dual_major"] == "취득 0.124 / 기준 30학점"


@pytest.mark.parametrize("named", ["long", "string"])
def test_dense_search_in_small_blocks(spark, monkeypatch, named):
    monkeypatch.setattr(index, "QUERY_ROWS", 3)
    monkeypatch.setattr(index, "VECTOR_ROWS", 7)
    rng = np.random.default_rng(6)
    rows = [(int(i) if named == "long" else f"k{i:03}", [float(x) for x in rng.integers(-2, 3, 3)] if i % 9 else [1.0, 0.0, 0.0]) for i in rng.permutation(100)]
    rows = [(i, v if any(v) else [1.0, 1.0, 1.0]) for i, v in rows]
    e = spark.createDataFrame(rows, f"vec_id {named}, embedding array<float>").repartition(3)
    asked = sorted(rows)[:8]
    cos = lambda a, b: round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 6)
    wanted = {(q, *x) for q, v in asked for x in [(k, i + 1) for i, (_, k) in enumerate(sorted((-cos(v, w), k) for k, w in rows)[:5])]}
    found = index.dense(e, spark.createDataFrame(asked, f"query_id {named}, vector array<float>"), 5)
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()} == wanted


def test_what_a_task_holds_of_a_dense_search():
    scores, keys = np.round(np.random.default_rng(7).random((4, 50)), 1), np.arange(50)
    kept = None
    for lo in range(0, 50, 9):
        kept = index._merged(kept, scores[:, lo : lo + 9], keys[lo : lo + 9], 6)
    assert kept[1].shape == (4, 6) and [list(k) for k in kept[1]] == [[k for _, k in sorted(zip(-s, keys, strict=True))[:6]] for s in scores]


def test_searches_read_texts_once(spark):
    plan = fusion(spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [line for line in plan if "FileScan parquet" in line]
    assert scans and not any("text" in line for line in scans)  # what is left of the texts was saved before


def test_narrowed_index_and_term_counts(spark, monkeypatch):
    docs = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["c", "a", "c", "c"]), (5, ["d"])]
    whole = index.build_index(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), tokens=F.col("tokens"))
    queries = spark.createDataFrame([(1, ["a", "c"]), (2, ["d", "x"]), (3, [])], "query_id int, tokens array<string>")
    found = lambda i: sorted(map(tuple, index.bm25(i, queries, 3).collect()))
    few = index.narrowed(whole, queries)
    assert found(few) == found(whole) and len(found(few)) == 3 and few.size.first() == whole.size.first()
    monkeypatch.setattr(index, "LITERAL_TERMS", 1)
    assert index.narrowed(whole, queries) is whole
    words = [(w, i) for i, ws in docs for w in ws or ()]
    assert {tuple(r) for r in index.term_counts(whole).collect()} == {(w, len({i for x, i in words if x == w}), sum(x == w for x, _ in words)) for w, _ in words}


def test_two_steps_from_several_starts(spark):
    """A node that two starts of an origin reach counts once."""
    edges = spark.createDataFrame([("a", "x", "r"), ("b", "x", "r"), ("b", "z", "r"), ("x", "y", "r"), ("x", "x", "r"), (None, "x", "r"), ("x", None, "r")], "src string, dst string, relation string")
    found = graph.within_two(spark.createDataFrame([("o", "a"), ("o", "b"), ("p", "q")], "origin string, node_id string"), edges, visits=3)
    assert sorted(tuple(r) for r in found.collect()) == [("o", "x", 1), ("o", "y", 2), ("o", "z", 1)]
