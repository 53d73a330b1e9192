"""Index, search, ranking and fusion over documents and embeddings; and the hybrid plan that joins them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import fixed, text
from corvane.operators import index, models, rank
from corvane.plans.text_queries import _LIST, _STEMS
from corvane.registry import query, values
from corvane.session import table
from corvane.shared import saved

#: query, words, entry year, doc types (none: all)
ASKED = [(1, "erth thea ndst", "2019", []), (2, "lich heit und", "2021", ["domestic", "faq"]), (3, "tion que les menta", None, ["guide", "notice"]), (4, "ción las", "x", [])]
_ASKED = values(ASKED, "query_id, text, year, types")
_TYPES = "CASE doc_id % 4 WHEN 0 THEN 'domestic' WHEN 1 THEN 'guide' WHEN 2 THEN 'faq' ELSE 'notice' END"
_SEARCH = f"list_filter({_STEMS}, lambda w: NOT list_contains({_LIST(fixed.SEARCH_STOPWORDS)}, w))"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks with a type, a cohort and pins."""
    kind = F.element_at(F.array(*map(F.lit, ("domestic", "guide", "faq", "notice"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf, "documents")
    return d.select("doc_id", "text", kind.alias("doc_type"), (2016 + F.col("doc_id") % 8).alias("cohort_from"), (2019 + F.col("doc_id") % 8).alias("cohort_to"), F.when(F.col("doc_id") % 3 == 0, "1").when(F.col("doc_id") % 3 == 1, "2").otherwise("").alias("semester"), (F.col("doc_id") % 8 == 3).alias("pinned"))


def questions(spark: SparkSession) -> DataFrame:
    q = spark.createDataFrame(ASKED, "query_id int, text string, year string, types array<string>")
    return q.withColumn("tokens", text.search_tokens(F.col("text")))


_BM25 = f"""tk AS (SELECT doc_id, {_SEARCH} AS ts FROM documents), dl AS (SELECT doc_id, len(ts) AS dl FROM tk), sz AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
po AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tk) GROUP BY ALL), te AS (SELECT term, count(*) AS df FROM po GROUP BY term),
qs AS (SELECT query_id, year, types, {_SEARCH} AS ts FROM {_ASKED}), qt AS (SELECT query_id, unnest(ts) AS term FROM qs),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN te USING (term) CROSS JOIN sz JOIN po USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)"""


def _index(spark: SparkSession, sf: str) -> index.Index:
    return index.build_index(table(spark, sf, "documents"))


def _asked(spark: SparkSession, sf: str) -> index.Index:
    """The index for the questions alone: a query that searches more than once reads the texts once."""
    return index.narrowed(_index(spark, sf), questions(spark))


@query("AGG06_index_terms", f"WITH {_BM25} SELECT term, df, sum(tf)::BIGINT AS cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM te JOIN po USING (term) CROSS JOIN sz GROUP BY term, df, n")
def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf)
    idf = F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6)
    return index.term_counts(i).crossJoin(F.broadcast(i.size)).select("term", "df", "cf", idf.alias("idf"))


@query("TOP02_bm25", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 20")
def top_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return index.bm25(_asked(spark, sf), questions(spark), 20)


@query(
    "FIL03_bm25_types",
    f"WITH {_BM25} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE doc_id % 4 IN (0, 2) AND score > 0 QUALIFY rank <= 10",
)
def bm25_types(spark: SparkSession, sf: str) -> DataFrame:
    return index.bm25(_asked(spark, sf), questions(spark), 10, allowed=chunks(spark, sf).where(F.col("doc_type").isin("domestic", "faq")).select("doc_id"))


_ALLOWED = f"""(TRY_CAST(year AS INTEGER) IS NULL OR (2016 + doc_id % 8 <= TRY_CAST(year AS INTEGER) AND 2019 + doc_id % 8 >= TRY_CAST(year AS INTEGER))) AND (len(types) = 0 OR list_contains(types, {_TYPES}))"""


@query("FIL01_metadata_filter", f"SELECT query_id, {_TYPES} AS doc_type, count(*) AS n, min(doc_id) AS first_id FROM documents CROSS JOIN {_ASKED} WHERE {_ALLOWED} AND (doc_id % 3 = 0 OR doc_id % 3 = 2) GROUP BY ALL")
def metadata_filter(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark).select("query_id", "year", "types")  # a literal relation
    pairs = chunks(spark, sf).join(F.broadcast(q), index.metadata_filter(F.col("year"), F.col("types"), F.lit("1")))
    return pairs.groupBy("query_id", "doc_type").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_DENSE = "SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q"


@query("TOP01_dense", f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_DENSE}) QUALIFY rank <= 10")
def top_dense(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return index.dense(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)


@query(
    "VEC01_normalized",
    "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))",
)
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    wide = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    sized = wide.withColumn("n", F.sqrt(add(F.transform("e", lambda x: x * x))))
    v = sized.select("vec_id", F.transform("e", lambda x: x / F.col("n")).alias("v"))
    return v.select("vec_id", F.round(add(F.transform("v", lambda x: x * x)), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(add(F.col("v")), 6).alias("total"))


@query(
    "VEC03_nearest_centroid",
    """WITH d AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label AS class, i, avg(x) AS m FROM d GROUP BY ALL),
    s AS (SELECT vec_id, label, class, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS score FROM d JOIN c USING (i) GROUP BY ALL)
    SELECT vec_id, label, class AS nearest, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) = 1""",
)
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids are one short vector a class; they are sent to the vectors."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = dims.groupBy(F.col("label").alias("class")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    scored = e.crossJoin(F.broadcast(centroids)).select("vec_id", "label", "class", F.round(index.cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))
    return scored.groupBy("vec_id", "label").agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("nearest"), F.max("score").alias("score"))


_RAW = f"""{_BM25}, rr AS (SELECT query_id, doc_id, {_TYPES} AS doc_type, doc_id % 8 = 3 AS pinned, doc_id % 5 = 0 AS has_url, query_id % 2 = 1 AS asks_url, round(score - 4, 6) AS raw FROM bm WHERE rank <= 20),
r1 AS (SELECT *, abs(max(raw) OVER (PARTITION BY query_id)) AS size FROM rr),
r2 AS (SELECT *, round(raw + CASE WHEN doc_type IN ('domestic', 'guide') THEN CASE WHEN asks_url AND has_url THEN size * 0.04 ELSE 0 END WHEN doc_type = 'faq' OR (doc_type = 'notice' AND pinned) THEN size * 0.05 WHEN asks_url AND has_url THEN size * 0.18 ELSE 0 END, 6) AS score FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place, max(score) OVER (PARTITION BY query_id) AS best FROM r2),
r4 AS (SELECT *, place <= 5 AND (place <= 3 OR score >= greatest(CASE WHEN best > 0 THEN best * 0.5 ELSE -1e300 END, -3)) AS kept, doc_type IN ('domestic', 'guide', 'scholarship', 'timetable', 'notice_attachment') AS document FROM r3),
r5 AS (SELECT *, bool_or(kept AND document) OVER (PARTITION BY query_id) AS any_document, count(*) FILTER (kept) OVER (PARTITION BY query_id) AS n_kept, min(CASE WHEN document AND NOT kept AND score >= -3 THEN place END) OVER (PARTITION BY query_id) AS spare FROM r4),
re AS (SELECT query_id, doc_id, doc_type, pinned, raw, score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM r5
       WHERE (kept AND NOT (NOT any_document AND spare IS NOT NULL AND n_kept >= 5 AND place = n_kept)) OR (NOT any_document AND place = spare))"""


def _scored(spark: SparkSession, sf: str, asked: index.Index | None = None) -> DataFrame:
    best = index.bm25(asked or _asked(spark, sf), questions(spark), 20).drop("rank")
    return best.join(chunks(spark, sf).select("doc_id", "doc_type", "pinned"), "doc_id").select("query_id", "doc_id", "doc_type", "pinned", (F.col("doc_id") % 5 == 0).alias("has_url"), (F.col("query_id") % 2 == 1).alias("asks_url"), F.round(F.col("score") - 4, 6).alias("raw"))


@query("TOP06_rerank", f"WITH {_RAW} SELECT query_id, doc_id, doc_type, raw, score, rank FROM re")
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    return rank.rerank(_scored(spark, sf), 5).select("query_id", "doc_id", "doc_type", "raw", "score", "rank")


@query("TOP08_rerank_notices", f"WITH {_RAW.replace('doc_id % 4 WHEN 0', '3 - (rank > 9)::INT * 3 WHEN 0')} SELECT query_id, doc_id, doc_type, raw, score, rank FROM re")
def reranked_notices(spark: SparkSession, sf: str) -> DataFrame:
    """Only low ranks are documents, so the last place goes to the best of them."""
    asked = _asked(spark, sf)
    low = index.bm25(asked, questions(spark), 20).select("query_id", "doc_id", F.when(F.col("rank") > 9, "domestic").otherwise("notice").alias("doc_type"))
    return rank.rerank(_scored(spark, sf, asked).drop("doc_type").join(low, ["query_id", "doc_id"]), 5).select("query_id", "doc_id", "doc_type", "raw", "score", "rank")


@query("TOP09_near_copies_out", f"WITH {_BM25} SELECT query_id, doc_id, score FROM bm JOIN documents USING (doc_id) WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY query_id, substr(text, 1, 100) ORDER BY score DESC, doc_id) = 1")
def near_copies_out(spark: SparkSession, sf: str) -> DataFrame:
    found = index.bm25(_asked(spark, sf), questions(spark), 20).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rank.near_copies_out(found).select("query_id", "doc_id", "score")


@query(
    "TOP10_knee_cut",
    f"""WITH {_BM25}, k AS (SELECT query_id, doc_id, score, rank, lag(score) OVER w - score AS fall, max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) AS span FROM bm WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id)),
    c AS (SELECT query_id, arg_max(rank, fall - rank * 1e-9) AS cut, max(fall) AS fall FROM k WHERE rank > 3 GROUP BY query_id)
    SELECT k.query_id, doc_id, score FROM k LEFT JOIN c USING (query_id) WHERE NOT coalesce(span >= 1 AND c.fall > 0.25 * span, false) OR rank < cut""",
)
def knee_cut(spark: SparkSession, sf: str) -> DataFrame:
    return rank.knee_cut(index.bm25(_asked(spark, sf), questions(spark), 20)).select("query_id", "doc_id", "score")


_FUSED = f"""{_RAW}, ch AS (SELECT query_id, doc_id AS doc_key, 'vector' AS channel, rank, doc_type, pinned FROM re UNION ALL
  SELECT query_id, doc_id, 'graph', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id), 'faq', false FROM sc WHERE doc_id % 4 = 2 AND score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 8),
fu AS (SELECT query_id, doc_key, round(sum(CASE WHEN channel = 'graph' THEN 2.0 / (10 + rank) ELSE 1.3 / (10 + rank) * CASE WHEN doc_type IN ('domestic', 'guide') THEN 1.3 WHEN doc_type = 'notice' AND pinned THEN 1.15 ELSE 1 END END), 6) AS score, min(channel) AS channel, min(doc_type) AS doc_type FROM ch GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM fu),
f1 AS (SELECT *, min(CASE WHEN score < 1 THEN rank END) OVER (PARTITION BY query_id) AS ref, arg_min(score, CASE WHEN score < 1 THEN rank END) OVER (PARTITION BY query_id) AS rs FROM fr),
f2 AS (SELECT *, min(CASE WHEN rank > greatest(3, ref + 2) AND rs > 0 AND score / rs < 0.7 THEN rank END) OVER (PARTITION BY query_id) AS cut FROM f1),
fc AS (SELECT query_id, doc_key, score, channel, doc_type, rank FROM f2 WHERE cut IS NULL OR rank < cut)"""


def _fused(spark: SparkSession, sf: str, asked: index.Index | None = None) -> DataFrame:
    asked = asked or _asked(spark, sf)
    vector = rank.rerank(_scored(spark, sf, asked), 5).select("query_id", F.col("doc_id").alias("doc_key"), F.lit("vector").alias("channel"), "rank", "doc_type", "pinned")
    faq = chunks(spark, sf).where("doc_type = 'faq'").select("doc_id")
    graph = index.bm25(asked, questions(spark), 8, allowed=faq).select("query_id", F.col("doc_id").alias("doc_key"), F.lit("graph").alias("channel"), "rank", F.lit("faq").alias("doc_type"), F.lit(False).alias("pinned"))
    g, v = rank.weights(F.lit("GRADUATION_REQ"), F.lit("factoid"))
    return rank.fuse(vector.unionByName(graph).withColumn("graph_weight", g).withColumn("vector_weight", v))


@query("TOP11_fusion", f"WITH {_FUSED} SELECT query_id, doc_key, score, channel, rank FROM fr")
def fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("query_id", "doc_key", "score", "channel", "rank")


@query("TOP13_adaptive_cut", f"WITH {_FUSED} SELECT query_id, doc_key, score, rank FROM fc")
def adaptive_cut(spark: SparkSession, sf: str) -> DataFrame:
    return rank.adaptive_cut(_fused(spark, sf)).select("query_id", "doc_key", "score", "rank")


@query(
    "TOP14_cross_boost",
    f"""WITH {_FUSED}, b AS (SELECT query_id, doc_key, doc_key % 40 AS page, round(CASE WHEN bool_or(channel = 'vector') OVER p AND bool_or(channel <> 'vector') OVER p THEN score * 1.2 ELSE score END, 6) AS score FROM fc WINDOW p AS (PARTITION BY query_id, doc_key % 40))
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM b""",
)
def cross_boost(spark: SparkSession, sf: str) -> DataFrame:
    return rank.cross_boost(rank.adaptive_cut(_fused(spark, sf)).withColumn("page", F.col("doc_key") % 40)).select("query_id", "doc_key", "page", "score", "rank")


@query("TOP15_promotion", f"WITH {_FUSED} SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_type = 'faq' AND doc_key % 8 = 2 THEN 0 WHEN doc_type = 'faq' AND doc_key % 16 = 6 THEN 2 ELSE 1 END, rank) AS rank FROM fr")
def promotion(spark: SparkSession, sf: str) -> DataFrame:
    faq, key = F.col("doc_type") == "faq", F.col("doc_key")
    order = F.when(faq & (key % 8 == 2), 0).when(faq & (key % 16 == 6), 2).otherwise(1)
    return rank.in_order(_fused(spark, sf), order).select("query_id", "doc_key", "rank")


@query("TOP17_context_selection")
def context_selection(spark: SparkSession, sf: str) -> DataFrame:
    """A fold, so tested against a plain model; the budget is that of the default intent."""
    rows = rank.adaptive_cut(_fused(spark, sf)).join(table(spark, sf, "documents").select(F.col("doc_id").alias("doc_key"), "text"), "doc_key")
    return rank.select_context(rows, F.lit(fixed.DEFAULT_BUDGET))


GATES = [(i, d, n, v, s, b, a) for i, (d, n, v, s, b, a) in enumerate([(True, 0, False, 0.0, 0, 0), (False, 4, True, 1.0, 6, 5), (False, 4, True, -1.0, 6, 5), (False, 1, True, 2.5, 4, 4), (False, 2, False, 9.0, 3, 3), (False, 3, True, 3.0, 10, 6), (False, 0, False, 0.0, 2, 0), (False, 5, True, 2.0, 5, 3)])]


@query(
    "GAT11_confidence",
    f"""SELECT id, round(CASE WHEN d THEN 1.0 WHEN n = 0 THEN 0.0 ELSE CASE WHEN b >= 5 AND a <= b * 0.6 THEN least(m, 0.4) ELSE m END END::DOUBLE, 6) AS confidence
    FROM (SELECT *, CASE WHEN v AND s < 0 THEN least(c, 0.3) WHEN v AND s > 2 THEN greatest(c, 0.8) ELSE c END AS m FROM (SELECT *, CASE WHEN n >= 3 THEN 0.8 WHEN n = 2 THEN 0.6 ELSE 0.4 END AS c FROM {values(GATES, "id, d, n, v, s, b, a")}))""",
)
def confidences(spark: SparkSession, sf: str) -> DataFrame:
    g = spark.createDataFrame(GATES, "id int, d boolean, n int, v boolean, s double, b int, a int")
    return g.select("id", F.round(rank.confidence(*map(F.col, "dnvsba")), 6).alias("confidence"))


POLICY = [(i, intent, kind) for i, (intent, kind) in enumerate([("SCHEDULE", "factoid"), ("GENERAL", "overview"), ("MAJOR_CHANGE", "reasoning"), ("UNKNOWN", "procedural"), ("COURSE_INFO", None)])]
_PAIR = lambda table, n: "CASE " + " ".join(f"WHEN {'intent' if table is fixed.INTENT_WEIGHTS else 'kind'} = '{k}' THEN {v[n]}" for k, v in table.items()) + f" ELSE {fixed.DEFAULT_WEIGHTS[n] if table is fixed.INTENT_WEIGHTS else 1.0} END"


@query(
    "TOP12_weight_policy",
    f"SELECT id, round(({_PAIR(fixed.INTENT_WEIGHTS, 0)}) * ({_PAIR(fixed.QUESTION_FACTORS, 0)}), 6)::DOUBLE AS graph_weight, round(({_PAIR(fixed.INTENT_WEIGHTS, 1)}) * ({_PAIR(fixed.QUESTION_FACTORS, 1)}), 6)::DOUBLE AS vector_weight, CASE "
    + " ".join(f"WHEN intent = '{k}' THEN {v}" for k, v in fixed.BUDGETS.items())
    + f" ELSE {fixed.DEFAULT_BUDGET} END AS budget FROM {values(POLICY, 'id, intent, kind')}",
)
def weight_policy(spark: SparkSession, sf: str) -> DataFrame:
    g, v = rank.weights(F.col("intent"), F.col("kind"))
    return spark.createDataFrame(POLICY, "id int, intent string, kind string").select("id", F.round(g, 6).alias("graph_weight"), F.round(v, 6).alias("vector_weight"), rank.budget(F.col("intent")).alias("budget"))


FAQS = [
    (1, "복수전공 신청은 언제 하나요", "복수전공 신청은 3월과 9월에 통합정보시스템에서 합니다"),
    (2, "졸업 학점은 몇 학점인가요", "졸업에는 130학점이 필요합니다"),
    (3, "휴학 신청 방법", "휴학은 학사지원팀 방문 또는 온라인으로 신청합니다"),
    (4, "수강신청 기간과 정정 기간", "수강신청 기간은 2월 중순, 정정 기간은 개강 첫 주입니다"),
    (5, "장학금 종류", "성적장학금과 근로장학금이 있습니다"),
    (6, "how to apply for dormitory", "apply for dormitory at the housing office"),
]
QUESTIONS = [(1, "복수전공 신청 언제"), (2, "졸업학점"), (3, "휴학하려면 어떻게 신청해야 하나요"), (4, "수강신청 정정 기간이 언제"), (5, "식사"), (6, "apply dormitory housing")]
_Q = lambda c: f"list_distinct({_STEMS.replace('text', c)})"
_STOP = _LIST(fixed.QUESTION_STOPWORDS)
_PARTS = lambda x: f"list_distinct(flatten(list_transform({x}, lambda t: CASE WHEN length(t) >= 4 THEN list_concat([t], list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) ELSE [t] END)))"
_FAQ_SQL = f"""WITH f AS (SELECT faq_id, {_Q("question")} AS q, {_Q("answer")} AS a FROM {values(FAQS, "faq_id, question, answer")}), nf AS (SELECT greatest(1, count(*)) AS n FROM f),
idf AS (SELECT token, ln(n / df) + 1 AS w FROM (SELECT token, count(*) AS df FROM (SELECT faq_id, unnest(list_distinct(list_concat(q, a))) AS token FROM f) GROUP BY token) CROSS JOIN nf),
q0 AS (SELECT query_id, {_Q("question")} AS st FROM {values(QUESTIONS, "query_id, question")}), q1 AS (SELECT query_id, list_filter(st, lambda w: NOT list_contains({_STOP}, w)) AS co, st FROM q0),
qq AS (SELECT query_id, CASE WHEN len(co) > 0 THEN co ELSE st END AS core, list_filter({_PARTS("st")}, lambda w: NOT list_contains({_STOP}, w)) AS keys FROM q1),
cand AS (SELECT DISTINCT query_id, faq_id FROM (SELECT query_id, unnest(keys) AS token FROM qq) JOIN (SELECT faq_id, unnest({_PARTS("list_concat(q, a)")}) AS token FROM f) USING (token)),
ws AS (SELECT query_id, faq_id, len(core) AS nc, core, q, a, unnest(list_distinct(list_concat(core, q, a))) AS token FROM cand JOIN qq USING (query_id) JOIN f USING (faq_id)),
wt AS (SELECT *, coalesce(w, 1.0) AS ww, list_contains(core, token) AS ic, list_contains(q, token) AS iq, list_contains(a, token) AS ia, NOT list_contains({_STOP}, token) AS re FROM ws LEFT JOIN idf USING (token)),
sm AS (SELECT query_id, faq_id, nc, sum(CASE WHEN ic AND iq THEN 2 * ww ELSE 0 END) + sum(CASE WHEN ic AND ia THEN ww ELSE 0 END) AS hit, sum(CASE WHEN iq AND re AND NOT ic THEN ww ELSE 0 END) AS extra, sum(CASE WHEN iq AND re THEN ww ELSE 0 END) AS asked,
  sum(CASE WHEN ic THEN 3 * ww ELSE 0 END) AS most, count(*) FILTER (ic AND (iq OR ia) AND re) AS cov, count(*) FILTER (ic AND iq AND re) AS covq, count(*) FILTER (ic AND re) AS nr FROM wt GROUP BY ALL),
sd AS (SELECT *, round(hit / sqrt(nc) * (1 - CASE WHEN extra > 0 THEN extra / asked * 0.7 ELSE 0 END), 6) AS raw FROM sm),
rk AS (SELECT *, round(least(raw / most, 1), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, faq_id) AS rank FROM sd WHERE raw > 0)
SELECT query_id, faq_id, raw, score, rank, rank = 1 AND (raw >= most * CASE nc WHEN 1 THEN 0.55 WHEN 2 THEN 0.5 ELSE 0.4 END OR (nr >= 3 AND covq >= 0.9 * nr)) AND (CASE WHEN nr > 0 THEN cov / nr ELSE 1 END >= 0.75 OR (nr >= 3 AND covq >= 0.9 * nr)) AS direct
FROM rk WHERE rank <= 5 AND score >= 0.1"""


@query("GAT13_faq_search", _FAQ_SQL)
def faq_search(spark: SparkSession, sf: str) -> DataFrame:
    faqs = spark.createDataFrame(FAQS, "faq_id int, question string, answer string")
    return index.faq_search(faqs, spark.createDataFrame(QUESTIONS, "query_id int, question string"), fixed.QUESTION_STOPWORDS)


_HYBRID = f"""WITH {_FUSED}, sel AS (SELECT query_id, count(*) AS n FROM fc GROUP BY query_id), pre AS (SELECT query_id, count(*) AS b FROM fr GROUP BY query_id), vt AS (SELECT query_id, max(score) AS top FROM re GROUP BY query_id)
SELECT query_id, rank, doc_key AS doc_id, score, round(CASE WHEN b >= 5 AND n <= b * 0.6 THEN least(m, 0.4) ELSE m END, 6) AS confidence,
  '---[' || doc_type || '] ' || text AS context
FROM (SELECT *, CASE WHEN top < 0 THEN least(c, 0.3) WHEN top > 2 THEN greatest(c, 0.8) ELSE c END AS m FROM (SELECT *, CASE WHEN n >= 3 THEN 0.8 WHEN n = 2 THEN 0.6 ELSE 0.4 END AS c FROM fc JOIN sel USING (query_id) JOIN pre USING (query_id) JOIN vt USING (query_id))) JOIN documents ON doc_id = doc_key"""


@query("PLAN_hybrid", _HYBRID)
def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword search, rerank, fusion with FAQ rows, adaptive cut, confidence and context rows."""
    asked = _asked(spark, sf)
    fused = saved(_fused(spark, sf, asked))  # some ten rows a question
    cut = rank.adaptive_cut(fused)
    before = fused.groupBy("query_id").agg(F.count("*").alias("b"))
    after = cut.groupBy("query_id").agg(F.count("*").alias("n"))
    top = rank.rerank(_scored(spark, sf, asked), 5).groupBy("query_id").agg(F.max("score").alias("top"))
    rows = cut.join(after, "query_id").join(before, "query_id").join(top, "query_id").join(table(spark, sf, "documents").select(F.col("doc_id").alias("doc_key"), "text"), "doc_key")
    sure = rank.confidence(F.lit(False), F.col("n"), F.lit(True), F.col("top"), F.col("b"), F.col("n"))
    return rows.select("query_id", "rank", F.col("doc_key").alias("doc_id"), "score", F.round(sure, 6).alias("confidence"), F.concat(F.lit("---["), "doc_type", F.lit("] "), "text").alias("context"))


# ---- injected models: stand-ins that count letters

_LETTERS = "aeinorst"


def _letters(texts: list[str]) -> np.ndarray:
    counts = np.array([[t.count(x) for x in _LETTERS] for t in texts], np.float64).reshape(-1, len(_LETTERS))
    return counts / np.maximum(1.0, np.sqrt((counts * counts).sum(1, keepdims=True)))


_COUNTS = "[" + ", ".join(f"(length(t) - length(replace(t, '{x}', '')))::DOUBLE" for x in _LETTERS) + "]"
_UNITS = f"SELECT doc_id, list_transform(c, lambda x: x / greatest(1, sqrt(list_sum(list_transform(c, lambda y: y * y))))) AS u FROM (SELECT doc_id, {_COUNTS} AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


@query("VEC04_embedded", f"SELECT doc_id, list_transform(u, lambda x: round(x, 4)) AS embedding FROM ({_UNITS})")
def embedded(spark: SparkSession, sf: str) -> DataFrame:
    found = models.embedded(table(spark, sf, "documents").select("doc_id", "text"), "text", lambda: _letters)
    return found.select("doc_id", F.transform("embedding", lambda x: F.round(x * 10_000) / 10_000).alias("embedding"))


@query("VEC05_pair_scores", f"WITH un AS ({_UNITS}) SELECT a.doc_id, round(list_dot_product(a.u, b.u), 6) AS score FROM un a JOIN un b ON b.doc_id = a.doc_id + 1")
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each document scored against the next one."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    found = models.scored(pairs, "text", "other", lambda: lambda questions, texts: (_letters(questions) * _letters(texts)).sum(1))
    return found.select("doc_id", F.round("score", 6).alias("score"))
