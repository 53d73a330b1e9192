"""Sources by round trips, streams by replayed batches."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking
from corvane.sources import html, logs
from corvane.streaming import changes, sessions
from corvane.streaming.versions import VersionedTable

SF = "/root/testdata/sf0.001"


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.sql("SELECT timestamp'2024-01-05 10:00:00' + make_interval(0, 0, 0, CAST(id % 3 AS INT)) AS timestamp, 's' || id AS session_id, 'q' AS question, id AS duration_ms FROM range(9)")
    logs.append_log(rows.where("duration_ms < 5"), path)
    logs.append_log(rows.where("duration_ms >= 5"), path)
    with open(next((tmp_path / "log").glob("log_date=2024-01-05")) / "part-extra.json", "w") as f:
        f.write('{"timestamp": "2024-01-05T11:00:00.000Z", "session_id": "x", "duration_ms": 99}\nnot json at all\n{"duration_ms": "wrong"}\n')
    found = logs.read_log(spark, path)
    assert found.count() == 11 and found.where('duration_ms IS NULL').count() == 1 and found.groupBy("log_date").count().count() == 3
    assert {r["session_id"] for r in found.where("log_date = '2024-01-05'").collect()} >= {"x"}
    with pytest.raises(Exception, match="without a time"):
        logs.append_log(rows.withColumn("timestamp", F.lit(None).cast("timestamp")), path)


def test_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(x) for x in [{"id": "1", "question": "a", "answer": "b", "source_page": 3}, {"id": "2", "question": "c", "ground_truth": "d", "lang": "en", "answerable": False, "evidence_page": [1, 2]}]))
    one, two = logs.read_questions(spark, str(tmp_path / "q.jsonl")).orderBy("id").collect()
    assert (one["ground_truth"], one["lang"], one["answerable"], one["evidence_page"]) == ("b", "ko", True, [3])
    assert (two["ground_truth"], two["lang"], two["answerable"], two["evidence_page"]) == ("d", "en", False, [1, 2])
    (tmp_path / "faq.json").write_text('[{"id": "f1", "question": "q"},\n {"id": "f2", "question": "r"}]')
    assert logs.read_collection(spark, str(tmp_path / "faq.json"), "id string, question string").count() == 2


PAGE = """<html><head><title>T</title><style>p {}</style><script>var x = "<p>no</p>";</script></head><body><nav>Menu</nav><h1>Top</h1><p>One&amp;two <b>bold</b></p>
<h3>Sub</h3><p>text</p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><th>K</th><td>v1</td><td>v2</td></tr><tr><td>x</td></tr></table><footer>End</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>open <i>x")], "page_id long, html string")
    texts = {r["page_id"]: r["text"] for r in html.page_texts(pages).collect()}
    assert texts[1].split("\n") == ["T", "Menu", "Top", "One&two", "bold", "Sub", "text", "A", "B", "1", "2", "K", "v1", "v2", "x", "End"]
    assert texts[2] == "" and texts[3] == "open\nx"
    assert not {"Menu", "End"} & set(html.page_texts(pages, main_only=True).where("page_id = 1").first()["text"].split("\n"))
    real = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html.page_texts(real).join(real.select("page_id", "html"), "page_id").limit(50).collect():
        assert not re.search(r"<(p|div|script)\b", r["text"]) and len(r["text"]) <= len(r["html"])


def _crawled(spark, rows):
    """Rows (crawl, source_id, content, day), or (crawl, None, None, day) for a crawl's end."""
    return spark.createDataFrame([(n, s, c, f"2024-01-{d:02} 00:00:00", s is None) for n, s, c, d in rows], "crawl_id long, source_id string, content string, at string, is_end boolean").selectExpr("crawl_id", "source_id", "content", "CAST(at AS timestamp) AS crawled_at", "is_end")


def _now(spark, out):
    state = {r["source_id"]: (str(r["first_seen"])[:10], str(r["last_seen"])[:10]) for r in changes.state_table(spark, out).latest().collect()}
    return {r["source_id"]: r["content"] for r in changes.page_table(spark, out).latest().collect()}, state


def test_crawls_over_several_batches(spark, tmp_path):
    """A crawl in three micro-batches deletes at its end only; what failed is found again; schemes that weren't crawled stay."""
    batches = [
        [(1, "http://a", "1", 1), (1, "http://b", "1", 1), (1, "faq://x", "1", 1)],
        [(1, "http://c", "1", 1)],
        [(1, None, None, 1)],
        [(2, "http://a", "2", 2)],
        [(2, "http://bad", "1", 2), (2, "http://c", "1", 2), (2, None, None, 2)],
        [(3, "http://bad", "1", 3), (3, "http://a", "2", 3), (3, None, None, 3)],
    ]
    source, out = tmp_path / "in", str(tmp_path / "out")
    fails = lambda events: events.where("source_id = 'http://bad' OR change = 'DELETED' AND source_id = 'http://c'")
    tables_after = []
    for batch in batches:
        _crawled(spark, batch).coalesce(1).write.mode("append").parquet(str(source))
        query = changes.follow(spark.readStream.schema(changes.CRAWL).parquet(str(source)), out, str(tmp_path / "cp"), fails)
        query.awaitTermination(120)
        assert query.exception() is None
        tables_after.append(set(_now(spark, out)[0]))
    first, all_ = {"http://a", "http://b", "faq://x"}, {"http://a", "http://b", "http://c", "faq://x"}
    assert tables_after == [first, all_, all_, all_, all_ - {"http://b"}, all_ - {"http://b"}]
    table, state = _now(spark, out)
    assert table == {"http://a": "2", "http://c": "1", "faq://x": "1"}
    assert state == {"http://a": ("2024-01-01", "2024-01-02"), "http://c": ("2024-01-01", "2024-01-01"), "faq://x": ("2024-01-01", "2024-01-01")}
    told = {(r["batch"], r["change"]): (r["n"], r["failed"]) for r in spark.read.parquet(f"{out}/log").collect()}
    assert told == {(0, "NEW"): (3, 0), (1, "NEW"): (1, 0), (3, "MODIFIED"): (1, 0), (4, "NEW"): (1, 1), (4, "DELETED"): (1, 0), (5, "NEW"): (1, 1), (5, "DELETED"): (1, 1)}


def test_a_batch_that_is_run_again(spark, tmp_path):
    out = str(tmp_path)
    changes.apply_batch(_crawled(spark, [(1, f"http://{i}", str(i), 1) for i in range(40)] + [(1, None, None, 1)]), 0, out)
    second = _crawled(spark, [(2, f"http://{i}", str(i % 7), 2) for i in range(30)] + [(2, None, None, 2)])

    def broken(events):
        raise RuntimeError("lost")

    pages = changes.page_table(spark, out)
    with pytest.raises(RuntimeError):
        changes.apply_batch(second, 1, out, broken)
    assert pages.versions() == [0] and pages.latest().count() == 40
    changes.apply_batch(second, 1, out)
    once = _now(spark, out)
    changes.apply_batch(second, 1, out)
    assert _now(spark, out) == once and once[0] == {f"http://{i}": str(i % 7) for i in range(30)}


def test_versions_of_a_table(spark, tmp_path):
    """A reader of a version sees it whole while the next is put in place; untouched parts aren't written again; old ones go."""
    table = VersionedTable(spark, str(tmp_path), "source_id string, n int", "source_id", parts=4)
    rows = lambda n, ids: spark.createDataFrame([(str(i), n) for i in ids], "source_id string, n int")
    assert table.latest().count() == 0
    table.write(rows(0, range(50)), 0, range(4))
    pinned = table.read(0)
    touched = {r["p"] for r in rows(1, [1]).select(table.part_of("source_id").alias("p")).collect()}
    table.write(rows(1, range(50)).where(table.part_of("source_id").isin(*touched)), 1, touched)
    assert {r["n"] for r in pinned.collect()} == {0} and pinned.count() == 50
    assert table.listed(1) == {p: int(p in touched) for p in range(4)} and table.latest().count() == 50
    table.write(rows(2, []), 2, touched)
    table.clean(keep=1)
    assert table.versions() == [2] and {r["n"] for r in table.latest().collect()} == {0} and not (tmp_path / "data" / "v1").exists()


def test_children_and_files(spark):
    rows = spark.createDataFrame([("f1", "http://a"), ("f2", "http://b"), ("f3", None)], "source_id string, parent_url string")
    gone = spark.createDataFrame([("http://a",)], "source_id string")
    assert {r["source_id"] for r in changes.without_children(rows, gone).collect()} == {"f2", "f3"}
    files = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "path string, file_hash string")
    assert {r["path"] for r in changes.changed_files(files, spark.createDataFrame([("p", "1"), ("q", "0")], "path string, file_hash string")).collect()} == {"q", "r"}


def _replay(spark, tmp_path, batches, build, mode):
    source = tmp_path / "events"
    for rows in batches:
        spark.createDataFrame(rows, "user_id long, at string").selectExpr("user_id", "CAST(at AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(str(source))
        stream = build(spark.readStream.schema("user_id long, ts timestamp").parquet(str(source)))
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


BATCHES = [[(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:10:00"), (2, "2024-01-01 10:05:00")], [(1, "2024-01-01 12:00:00")], [(3, "2024-01-01 15:00:00")]]


def test_closed_sessions(spark, tmp_path):
    found = _replay(spark, tmp_path, BATCHES, lambda s: sessions.closed_sessions(s, "user_id", late="10 minutes"), "append")
    assert {(r["user_id"], str(r["started"])[11:16], r["n"]) for r in found} == {(1, "10:00", 2), (2, "10:05", 1), (1, "12:00", 1)}


def test_live_sessions(spark, tmp_path):
    found = _replay(spark, tmp_path, BATCHES, lambda s: sessions.live_sessions(s, "user_id", 30 * 60_000), "update")
    assert {(r["user_id"], r["n"]) for r in found if not r["expired"]} >= {(1, 2), (2, 1), (3, 1)}
    assert {(r["user_id"], r["n"]) for r in found if r["expired"]} >= {(2, 1)}


def test_table_pieces(spark):
    def model(md, most=chunking.TABLE_CAP):
        rows = md.split("\n")
        if len(md) <= most or len(rows) < 3:
            return [md]
        out, head, part = [], rows[:2], []
        for row in rows[2:]:
            if part and len("\n".join([*head, *part, row])) + 1 > most:
                out.append("\n".join(head + part))
                part = []
            part.append(row)
        return [*out, "\n".join(head + part)]

    rng = random.Random(4)
    cases = ["| a |\n|---|\n" + "\n".join("| " + "x" * rng.randrange(400) + " |" for _ in range(n)) for n in (0, 1, 5, 20, 60)] + ["y" * 5000, "a\nb\n" + "z" * 4000]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, md string").select("i", chunking.table_pieces(F.col("md")).alias("p"))
    for r in df.collect():
        assert r["p"] == model(cases[r["i"]])


def test_table_pieces_make_their_text_once(spark):
    """The fold works on bound values; the text's own expression stands in it once, not in every row's step."""
    assert str(chunking.table_pieces(F.upper(F.col("md")))).count("upper(md)") == 1


def test_pages_are_held_a_few_at_a_time(spark):
    """A task's batch of pages is bounded by bytes, not by 10,000 rows of any size."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = spark.range(200).selectExpr("id AS page_id", "if(id % 50 = 7, NULL, concat('<nav>n</nav><p>', repeat('x', id * 10), '</p>')) AS html")
    found = {r["page_id"]: r["text"] for r in html.page_texts(pages, main_only=True).collect()}
    assert found == {i: "" if i % 50 == 7 else "x" * (i * 10) for i in range(200)} and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= html.BATCH_BYTES
