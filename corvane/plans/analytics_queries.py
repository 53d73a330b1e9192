"""Log analytics over events, evaluation over labels, benchmark and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import evaluate, logs
from corvane.plans.text_queries import _STEMS
from corvane.registry import query
from corvane.session import table

_LOG = """lg AS (SELECT event_id AS id, ts, user_id AS session, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS intent, value AS duration, CASE WHEN k % 3 = 0 THEN k % 5 + 1 END AS rating, event_type || ' ' || k % 4 AS question, CASE WHEN k % 7 = 0 THEN '' ELSE 'answer ' || k END AS answer, k
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""
_TODAY = "2024-01-15"


def log(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("intent"), F.col("value").alias("duration"),
        F.when(k % 3 == 0, k % 5 + 1).alias("rating"), F.concat("event_type", F.lit(" "), k % 4).alias("question"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("answer "), k)).alias("answer"), k.alias("k"),
    )


def _naive(*columns: str) -> list:
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in columns]


@query("AGG01_kpi", f"WITH {_LOG} SELECT count(*) AS total, count(*) FILTER (ts::DATE = DATE '{_TODAY}') AS today, round(coalesce(avg(duration), 0) / 1000, 6) AS avg_seconds FROM lg")
def kpi(spark: SparkSession, sf: str) -> DataFrame:
    return logs.kpi(log(spark, sf), F.to_date(F.lit(_TODAY)))


@query(
    "AGG02_daily",
    f"WITH {_LOG} SELECT d.day::DATE AS day, count(id) AS n FROM (SELECT unnest(generate_series(DATE '{_TODAY}' - 6, DATE '{_TODAY}', INTERVAL 1 DAY)) AS day) d LEFT JOIN lg ON ts::DATE = d.day::DATE GROUP BY ALL",
)
def daily(spark: SparkSession, sf: str) -> DataFrame:
    return logs.daily(log(spark, sf), F.to_date(F.lit(_TODAY)))


@query("AGG03_intents", f"WITH {_LOG} SELECT coalesce(intent, 'GENERAL') AS intent, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(intent, 'GENERAL')) AS rank FROM lg GROUP BY coalesce(intent, 'GENERAL')")
def intents(spark: SparkSession, sf: str) -> DataFrame:
    return logs.intents(log(spark, sf))


@query(
    "AGG04_filtered",
    f"WITH {_LOG}, c AS (SELECT session, intent, count(*) AS n, sum(duration) AS d FROM lg WHERE ts >= TIMESTAMP '2024-01-05' AND intent IS NOT NULL GROUP BY ALL) SELECT session, sum(n)::BIGINT AS total, round(sum(d) / sum(n), 6) AS avg_ms, arg_max(intent, (n, intent)) AS top_intent FROM c GROUP BY session",
)
def filtered(spark: SparkSession, sf: str) -> DataFrame:
    return logs.summary(log(spark, sf).where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & F.col("intent").isNotNull()), "session")


@query("TOP27_recent", f"WITH {_LOG} SELECT id, strftime(ts, '%m-%d %H:%M') AS time, intent, duration, CASE WHEN rating > 0 THEN repeat('*', rating) ELSE '-' END AS rating FROM lg ORDER BY ts DESC, id DESC LIMIT 10")
def recent(spark: SparkSession, sf: str) -> DataFrame:
    return logs.recent(log(spark, sf))


@query("TOP26_page", f"WITH {_LOG} SELECT id, rating, question FROM lg ORDER BY rating NULLS FIRST, ts DESC, id DESC LIMIT 20 OFFSET 40")
def page(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).orderBy(F.asc_nulls_first("rating"), F.desc("ts"), F.desc("id")).offset(40).limit(20).select("id", "rating", "question")


@query(
    "STR10_latest_rating",
    f"""WITH {_LOG}, ra AS (SELECT session, question, ts + INTERVAL 1 MINUTE AS rated_at, k % 5 + 1 AS new FROM lg WHERE k % 11 = 0), la AS (SELECT session, question, ts::DATE AS day, arg_max(id, (ts, id)) AS id FROM lg GROUP BY ALL),
    ne AS (SELECT session, question, rated_at::DATE AS day, arg_max(new, rated_at) AS new FROM ra GROUP BY ALL), ch AS (SELECT id, new FROM la JOIN ne USING (session, question, day))
    SELECT id, coalesce(new, rating) AS rating FROM lg LEFT JOIN ch USING (id)""",
)
def latest_rating(spark: SparkSession, sf: str) -> DataFrame:
    all_rows = log(spark, sf)
    late = all_rows.where("k % 11 = 0").select("session", "question", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("rated_at"), (F.col("k") % 5 + 1).alias("rating"))
    return logs.latest_rating(all_rows, late).select("id", "rating")


@query(
    "STR07_sessions",
    f"""WITH {_LOG}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM lg WINDOW w AS (PARTITION BY session ORDER BY ts, id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, id) AS run FROM g) SELECT session, min(ts) AS begin, max(ts) AS last, count(*) AS n FROM s GROUP BY session, run""",
)
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return logs.sessions(log(spark, sf)).select("session", *_naive("begin", "last"), "n")


@query(
    "FIL07_uncovered",
    f"WITH {_LOG} SELECT question, count(*) AS n, max(ts) AS last_asked, min(id) AS first_id FROM lg WHERE ts::DATE >= DATE '2024-01-03' AND length(trim(question)) >= 2 AND (trim(answer) = '' OR contains(answer, '찾을 수 없습니다') OR coalesce(rating <= 2, false)) GROUP BY question",
)
def uncovered(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs.uncovered(log(spark, sf), F.to_date(F.lit("2024-01-03")), text.is_refusal(F.col("answer")))
    return rows.groupBy("question").agg(F.count("*").alias("n"), F.max("ts").cast("timestamp_ntz").alias("last_asked"), F.min("id").alias("first_id"))


@query("SRC03_dates", f"WITH {_LOG} SELECT ts::DATE AS day, count(*) AS n, row_number() OVER (ORDER BY ts::DATE DESC) AS rank FROM lg GROUP BY ts::DATE")
def dates(spark: SparkSession, sf: str) -> DataFrame:
    days = log(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("day"))))  # a row a day


@query("SRC04_job_history", f"WITH {_LOG} SELECT session AS job, id, duration, row_number() OVER (PARTITION BY session ORDER BY ts DESC, id DESC) AS place FROM lg QUALIFY place <= 3")
def job_history(spark: SparkSession, sf: str) -> DataFrame:
    latest = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("id"))
    return log(spark, sf).withColumn("place", F.row_number().over(latest)).where("place <= 3").select(F.col("session").alias("job"), "id", "duration", "place")


_PAIRS = f"""st AS MATERIALIZED (SELECT item_id, {_STEMS} AS ts FROM benchmark), nu AS MATERIALIZED (SELECT count(*) AS n FROM benchmark),
sh AS MATERIALIZED (SELECT item_id AS key, (item_id + 1) % n AS other, ts AS p FROM st CROSS JOIN nu), pa AS MATERIALIZED (SELECT sh.key, sh.p, st.ts AS e FROM sh JOIN st ON st.item_id = sh.other)"""


def _answer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select("item_id", text.stems(F.col("text")).alias("ts"))
    n = b.agg(F.count("*").alias("n"))  # one row
    return b.crossJoin(F.broadcast(n)).select(F.col("item_id").alias("key"), ((F.col("item_id") + 1) % F.col("n")).alias("other"), F.col("ts").alias("p")).join(b.select(F.col("item_id").alias("other"), F.col("ts").alias("e")), "other").select("key", "p", "e")


@query(
    "AGG17_token_f1",
    f"""WITH {_PAIRS}, a AS (SELECT key, t, count(*) AS c FROM (SELECT key, unnest(p) AS t FROM pa) GROUP BY ALL), b AS (SELECT key, t, count(*) AS c FROM (SELECT key, unnest(e) AS t FROM pa) GROUP BY ALL), s AS (SELECT key, sum(least(a.c, b.c)) AS same FROM a JOIN b USING (key, t) GROUP BY key)
    SELECT key, round(CASE WHEN np = 0 AND ne = 0 THEN 1 WHEN same = 0 THEN 0 ELSE same / np END::DOUBLE, 6) AS precision, round(CASE WHEN np = 0 AND ne = 0 THEN 1 WHEN same = 0 THEN 0 ELSE same / ne END::DOUBLE, 6) AS recall, round(CASE WHEN np = 0 AND ne = 0 THEN 1 WHEN same = 0 THEN 0 ELSE 2 * same / (np + ne) END::DOUBLE, 6) AS f1
    FROM (SELECT key, len(p) AS np, len(e) AS ne, coalesce(same, 0) AS same FROM pa LEFT JOIN s USING (key))""",
)
def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.token_overlap(_answer_pairs(spark, sf), "key", F.col("p"), F.col("e"))


_FOUND = "fo AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey % 12 AS page FROM orders), go AS (SELECT c_custkey AS query_id, c_custkey % 12 AS page FROM customer)"


@query(
    "AGG18_retrieval",
    f"""WITH {_FOUND}, h AS (SELECT query_id, min(rank) FILTER (rank <= 5) AS b5, min(rank) AS ball FROM fo JOIN go USING (query_id) WHERE abs(fo.page - go.page) <= 1 AND go.page <> 0 GROUP BY query_id)
    SELECT query_id, CASE WHEN b5 IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS recall, round(coalesce(1.0 / b5, 0)::DOUBLE, 6) AS mrr, CASE WHEN ball IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS recall_all FROM go LEFT JOIN h USING (query_id)""",
)
def retrieval(spark: SparkSession, sf: str) -> DataFrame:
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    found = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.row_number().over(best).alias("rank"), (F.col("o_orderkey") % 12).alias("page"))
    gold = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 12).alias("page"))
    everywhere = evaluate.retrieval(found, gold, None, 1).select("query_id", F.col("recall").alias("recall_all"))
    return evaluate.retrieval(found, gold, 5, 1).join(everywhere, "query_id")


_JUDGED = "ju AS (SELECT l.*, length(text) > 600 AS answered, quality = 1 AS ok, lang FROM labels l JOIN documents USING (doc_id))"


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", (F.length("text") > 600).alias("answered")), "doc_id").withColumn("ok", F.col("quality") == 1)


@query(
    "AGG21_classification",
    f"""WITH {_JUDGED}, c AS (SELECT lang, count(*) AS total, count(*) FILTER (answered AND ok) AS tp, count(*) FILTER (answered AND NOT ok) AS fp, count(*) FILTER (NOT (answered AND ok)) AS fn FROM ju GROUP BY lang),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c)
    SELECT lang, total, tp, fp, fn, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1 FROM r""",
)
def classification(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.classification(_judged(spark, sf), F.col("answered"), F.col("ok"), "lang")


@query("AGG22_answerable", f"WITH {_JUDGED} SELECT toxic = 0 AS answerable, count(*) AS n, round(avg(CASE WHEN answered AND ok THEN 1.0 ELSE 0 END)::DOUBLE, 4) AS accuracy, count(*) FILTER (NOT answered) AS refused, count(*) FILTER (answered AND NOT ok) AS invented FROM ju GROUP BY ALL")
def answerable(spark: SparkSession, sf: str) -> DataFrame:
    right = F.col("answered") & F.col("ok")
    return _judged(spark, sf).groupBy((F.col("toxic") == 0).alias("answerable")).agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 4).alias("accuracy"), F.count_if(~F.col("answered")).alias("refused"), F.count_if(F.col("answered") & ~F.col("ok")).alias("invented"))


@query(
    "AGG25_grouping_sets",
    f"WITH {_JUDGED} SELECT grouping(lang, quality) AS level, lang, quality, toxic, count(*) AS n, round(avg(CASE WHEN answered THEN 1.0 ELSE 0 END)::DOUBLE, 4) AS answered FROM ju GROUP BY GROUPING SETS ((), (lang), (lang, quality), (toxic))",
)
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = _judged(spark, sf)
    sets = rows.groupingSets([[], ["lang"], ["lang", "quality"], ["toxic"]], "lang", "quality", "toxic")
    level = F.grouping("lang") * 2 + F.grouping("quality")
    return sets.agg(level.cast("long").alias("level"), F.count("*").alias("n"), F.round(F.avg(F.col("answered").cast("double")), 4).alias("answered")).select("level", "lang", "quality", "toxic", "n", "answered")


@query("AGG26_percentiles", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in (("p0", 0.0), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p100", 1.0))) + " FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.percentiles(table(spark, sf, "events"), "value", "event_type")


@query("AGG27_index_percentiles", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS spread, round(list_sort(list(value))[(0.5 * count(*))::INT + CASE WHEN (0.5 * count(*))::INT > floor(0.5 * count(*)) THEN 0 ELSE 1 END], 6) AS middle FROM events GROUP BY event_type")
def index_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The value at half the count, by a rank rather than a gathered list."""
    e = table(spark, sf, "events")
    n = F.count("*").over(Window.partitionBy("event_type"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("value")) - 1
    marked = e.withColumn("here", place == F.floor(n * 0.5))
    return marked.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("spread"), F.round(F.max(F.when(F.col("here"), F.col("value"))), 6).alias("middle"))


@query(
    "AGG28_threshold_grid",
    "SELECT t1, t2, label, count(*) FILTER (a >= t1 AND b >= t2) AS n_and, count(*) FILTER (a >= t1 OR b >= t2) AS n_or FROM (SELECT l_discount * 100 AS a, l_tax * 100 AS b, l_returnflag AS label FROM lineitem) CROSS JOIN (SELECT unnest([2.0, 4.0, 6.0, 8.0])::DOUBLE AS t1) CROSS JOIN (SELECT unnest([1.0, 3.0, 5.0, 6.0, 7.0])::DOUBLE AS t2) GROUP BY ALL",
)
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b"), "l_returnflag")
    return evaluate.threshold_grid(rows, "a", "b", "l_returnflag", [2.0, 4.0, 6.0, 8.0], [1.0, 3.0, 5.0, 6.0, 7.0])


@query(
    "AGG29_run_comparison",
    "WITH w AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY ts, event_id) AS n FROM events) SELECT event_type, user_id % 2 AS run, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM w WHERE n > 3 GROUP BY ALL",
)
def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The first three of each run are warm-ups."""
    order = Window.partitionBy("event_type", F.col("user_id") % 2).orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("n", F.row_number().over(order)).where("n > 3")
    return rows.groupBy("event_type", (F.col("user_id") % 2).alias("run")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("AGG30_duplicates", "SELECT source, count(*) AS n, count(*) - count(DISTINCT substr(text, 1, 100)) AS duplicates, round(1 - count(DISTINCT substr(text, 1, 100)) / count(*), 6) AS rate, count(*) FILTER (lang IS NOT NULL AND n_chars > 0) AS covered FROM documents GROUP BY source")
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    heads = table(spark, sf, "documents").groupBy("source", F.substring("text", 1, 100).alias("head")).agg(F.count("*").alias("n"), F.count_if(F.col("lang").isNotNull() & (F.col("n_chars") > 0)).alias("c"))
    return heads.groupBy("source").agg(F.sum("n").alias("n"), (F.sum("n") - F.count("*")).alias("duplicates"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("rate"), F.sum("c").alias("covered"))


@query("WIN_tumbling_sliding", "SELECT 'day' AS kind, event_type, date_trunc('day', ts) AS begin, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'slide', event_type, begin, count(*) FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 6 HOUR]) AS begin FROM events) GROUP BY ALL")
def tumbling_sliding(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    part = lambda kind, w: e.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "event_type", F.col("w.start").cast("timestamp_ntz").alias("begin"), "n")
    return part("day", F.window("ts", "1 day")).unionByName(part("slide", F.window("ts", "12 hours", "6 hours")))
