"""Every registered query against its DuckDB twin, on the smallest tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corvane.plans.all  # noqa: F401
from corvane.operators import chunking, index, rank
from corvane.registry import ORACLE, QUERIES
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert not differences(found, ORACLE[name], SF)
    else:
        assert found.count() > 0


MARKS = [["\n\n"], ["다."], ["까."], [".\n"], ["?\n"], ["!\n"], [". "], ["? "], ["! "], [", "], ["\n"]]


def model_natural(text: str) -> list[str]:
    """Written from the rule: the last boundary of the best kind that lies in the last fifth of 700 characters."""
    text, out, at = text.strip(), [], 0
    while text:
        end = min(at + 700, len(text))
        if end < len(text):
            last_fifth = text[at + 560 : end]
            kinds = [last_fifth.rfind(m) + len(m) for (m,) in MARKS if m in last_fifth]
            end = at + 560 + kinds[0] if kinds else end
        out.append(text[at:end].strip())
        if end == len(text):
            break
        at = max(at + 1, end - 100)
    return [c for c in out if len(c) >= 150]


def model_packed(text: str) -> list[str]:
    chunks, open_ = [], ""
    for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
        if len((open_ + "\n\n" + p).strip() if open_ else p) <= 500:
            open_ = (open_ + "\n\n" + p).strip()
            continue
        chunks += [open_] * bool(open_)
        if len(p) > 500:
            *cut, open_ = [c for i in range(0, len(p), 420) if (c := p[i : i + 500]).strip()]
            chunks += cut
        else:
            open_ = (chunks[-1][-80:] + "\n\n" + p).strip()
    return chunks + [open_] * bool(open_)


def chunk_cases() -> list[str]:
    rng = random.Random(7)
    parts = ["\n\n", "다.", "까. ", "요. ", ".\n", "? ", "! ", ", ", "\n", " ", "x" * 30, "가나다 라마", "word ", "   "]
    return ["", " \n ", "short", "a" * 149, "a" * 150, "b" * 5000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(600))) for _ in range(60)]


def test_natural_chunks():
    for text in chunk_cases():
        assert chunking.natural_chunks(text) == model_natural(text)


def test_packed_paragraphs(spark):
    cases = chunk_cases()
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    found: dict[int, list] = {}
    for r in chunking.chunk_texts(rows, "packed").orderBy("doc_id", "pos").collect():
        found.setdefault(r["doc_id"], []).append(r["chunk"])
    for i, text in enumerate(cases):
        assert found.get(i, []) == model_packed(text), text


def test_context_selection(spark):
    """The fold against a loop over rows."""
    rng = random.Random(3)
    rows = [(q, r + 1, rng.choice(["", "  ", "same start " * 20, "y" * rng.randrange(1, 900), f"{rng.random()} " + "z" * rng.randrange(900)])) for q in range(40) for r in range(rng.randrange(9))]
    budget, most = 900, 600
    wanted = {}
    for q in range(40):
        used, seen = 0, set()
        for query, r, text in rows:
            head = text.strip(" ")[:120]
            if query != q or not head or head in seen:
                continue
            seen.add(head)
            if most - used >= 80:
                taken = min(len(text), most - used, int(most * 0.6))
                used += taken
                wanted[q, r] = taken
    found = rank.select_context(spark.createDataFrame(rows, "query_id int, rank int, text string"), F.lit(budget)).collect()
    assert {(r["query_id"], r["rank"]): r["taken"] for r in found} == wanted


def test_dense_in_query_blocks(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    queries = e.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    whole, parts = (sorted(map(tuple, index.dense(e, queries, 5, query_rows=n).collect())) for n in (10_000, max(1, queries.count() // 3)))
    assert len(whole) == 5 * queries.count() and whole == parts
