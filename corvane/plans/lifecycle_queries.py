"""Chunks, table changes, the property graph and course records, over the test tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import fixed
from corvane.operators import chunking, graph, records, tables
from corvane.registry import query, values
from corvane.session import table

# ---- chunks


@query(
    "CHK02_fixed_windows",
    rf"SELECT doc_id, pos, md5(chunk) AS digest FROM (SELECT doc_id, (b / {chunking.SIZE - chunking.OVERLAP})::INT AS pos, substr(text, b + 1, {chunking.SIZE}) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), {chunking.SIZE - chunking.OVERLAP})) AS b FROM documents)) WHERE regexp_replace(chunk, '[\s]', '', 'g') != ''",
)
def fixed_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, sf, "documents")).select("doc_id", "pos", F.md5("chunk").alias("digest"))


@query("CHK03_natural_chunks")
def natural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_texts(table(spark, sf, "documents"), "natural")


@query("CHK01_packed_paragraphs")
def packed_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_texts(table(spark, sf, "documents"), "packed")


@query(
    "FIL10_reject_reason",
    f"""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'metadata' WHEN n < CASE WHEN tab THEN {chunking.TABLE_LEAST} ELSE {chunking.LEAST} END THEN 'short' WHEN n > CASE WHEN tab THEN {chunking.TABLE_CAP} ELSE {chunking.HARD_CAP} END THEN 'long'
    WHEN g > CASE WHEN tab THEN 0.40 ELSE 0.20 END THEN 'garbage' END AS reason FROM (SELECT doc_id, lang, length(text) AS n, doc_id % 2 = 0 AS tab, doc_id % 10 / 20 AS g FROM documents)""",
)
def reject_reason(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", chunking.reject_reason(F.col("text"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 10 / 20, F.col("lang") != "fr").alias("reason"))


@query(
    "SCA23_chunk_keys",
    "SELECT doc_id, md5(concat_ws(':', source, (doc_id % 7)::VARCHAR, lang, substr(text, 1, 50))) AS chunk_key, concat_ws('_', substr(md5(source), 1, 8), lpad((doc_id % 7)::VARCHAR, 3, '0'), lpad((doc_id % 90)::VARCHAR, 2, '0'), substr(sha256(text), 1, 8)) AS versioned FROM documents",
)
def keys(spark: SparkSession, sf: str) -> DataFrame:
    page, text = F.col("doc_id") % 7, F.col("text")
    return table(spark, sf, "documents").select("doc_id", chunking.chunk_key(F.col("source"), page, F.col("lang"), text).alias("chunk_key"), chunking.versioned_key(F.md5("source"), page, F.col("doc_id") % 90, text).alias("versioned"))


# ---- table changes: the orders of two snapshots

_OLD = "old AS (SELECT (CASE WHEN o_orderkey % 2 = 0 THEN 'http://' ELSE 'file://' END) || o_orderkey AS source_id, md5(o_orderpriority) AS content_hash FROM orders WHERE o_orderkey % 5 != 0)"
_NEW = "new AS (SELECT 'http://' || o_orderkey AS source_id, md5(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END) AS content_hash FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 != 0)"
_EVENTS = f"""{_OLD}, {_NEW}, ev AS (SELECT source_id, CASE WHEN o.content_hash IS NULL THEN 'NEW' WHEN n.content_hash IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change, o.content_hash AS old_hash, n.content_hash AS new_hash
FROM old o FULL JOIN new n USING (source_id) WHERE o.content_hash IS DISTINCT FROM n.content_hash AND NOT (n.content_hash IS NULL AND source_id LIKE 'file://%'))"""


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 5 != 0).select(F.concat(F.when(k % 2 == 0, "http://").otherwise("file://"), k).alias("source_id"), F.md5("o_orderpriority").alias("content_hash"))
    new = o.where((k % 2 == 0) & (k % 7 != 0)).select(F.concat(F.lit("http://"), k).alias("source_id"), F.md5(F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))).alias("content_hash"))
    return old, new


@query("STR02_changes", f"WITH {_EVENTS} SELECT * FROM ev")
def changes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.changes(*snapshots(spark, sf))


@query("STR03_apply_changes", f"WITH {_EVENTS} SELECT * FROM old WHERE source_id NOT IN (SELECT source_id FROM ev) UNION ALL SELECT new.* FROM new JOIN ev USING (source_id) WHERE change != 'DELETED'")
def apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    old, new = snapshots(spark, sf)
    return tables.apply_changes(old, tables.changes(old, new), new)


@query(
    "STR01_commit_state",
    f"""WITH {_EVENTS}, failed AS (SELECT source_id FROM ev WHERE source_id LIKE '%1'), done AS (SELECT * FROM ev WHERE source_id NOT IN (SELECT source_id FROM failed)),
    st AS (SELECT *, DATE '2024-01-01' AS first_seen, DATE '2024-01-01' AS last_seen FROM old)
    SELECT source_id, coalesce(new_hash, content_hash) AS content_hash, coalesce(first_seen, DATE '2024-02-01') AS first_seen, CASE WHEN change IS NOT NULL THEN DATE '2024-02-01' ELSE last_seen END AS last_seen FROM st FULL JOIN done USING (source_id) WHERE change IS NULL OR change != 'DELETED'""",
)
def commit_state(spark: SparkSession, sf: str) -> DataFrame:
    old, new = snapshots(spark, sf)
    day = lambda d: F.to_date(F.lit(d))
    state = old.withColumn("first_seen", day("2024-01-01")).withColumn("last_seen", day("2024-01-01"))
    events = tables.changes(old, new)
    return tables.commit_state(state, events, events.where("source_id LIKE '%1'"), day("2024-02-01"))


@query("SNK02_upsert", f"WITH {_OLD}, {_NEW} SELECT * FROM old WHERE source_id NOT IN (SELECT source_id FROM new) UNION ALL SELECT * FROM new")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    return tables.upsert(*snapshots(spark, sf), "source_id")


@query("SNK09_insert_new", f"WITH {_OLD}, {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE source_id NOT IN (SELECT source_id FROM old)")
def insert_new(spark: SparkSession, sf: str) -> DataFrame:
    return tables.insert_new(*snapshots(spark, sf), "source_id")


@query("SNK03_delete_by_source", "SELECT doc_id, source FROM documents WHERE source != 'src1' UNION ALL SELECT doc_id + 1000000, source FROM documents WHERE lang != 'de'")
def delete_by_source(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", F.col("source").alias("source_file"), F.col("lang").alias("source_url"))
    gone = tables.delete_by_source(d, "src1").unionByName(tables.delete_by_source(d.withColumn("doc_id", F.col("doc_id") + 1_000_000), "de"))
    return gone.select("doc_id", "source")


@query("SET06_newest", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def newest(spark: SparkSession, sf: str) -> DataFrame:
    return tables.newest(table(spark, sf, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SNK12_pivot_entries", "SELECT o_custkey AS id, max(o_orderpriority) FILTER (o_orderstatus = 'F') AS f, max(o_orderpriority) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey")
def pivot_entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("name")).agg(F.max("o_orderpriority").alias("value"))
    return tables.pivot_entries(rows).select("id", F.try_element_at("meta", F.lit("F")).alias("f"), F.try_element_at("meta", F.lit("O")).alias("o"))


# ---- the graph: suppliers, parts and the orders' lines between them

_NODES = "nodes AS (SELECT 's' || s_suppkey AS node_id, 'supplier' AS node_type FROM supplier UNION ALL SELECT 'p' || p_partkey, p_brand FROM part)"
_EDGES = "edges AS (SELECT src, dst, min(rel) AS relation FROM (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag AS rel FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT 'p' || l_partkey, 's' || (l_suppkey % 7 + 1), l_linestatus FROM lineitem WHERE l_linenumber % 2 = 0) GROUP BY src, dst)"


def property_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s, p, li = (table(spark, sf, t) for t in ("supplier", "part", "lineitem"))
    nodes = s.select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit("supplier").alias("node_type"), F.create_map(F.lit("name"), F.col("s_name")).alias("attrs"))
    nodes = nodes.unionByName(p.select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_brand").alias("node_type"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string")).alias("attrs")))
    one = li.where("l_linenumber % 2 = 1").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("rel"))
    back = li.where("l_linenumber % 2 = 0").select(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), F.col("l_suppkey") % 7 + 1), "l_linestatus")
    return nodes, one.union(back).groupBy("src", "dst").agg(F.min("rel").alias("relation"))


@query(
    "GRA01_upsert_nodes",
    "SELECT 'p' || p_partkey AS node_id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_brand END AS node_type, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size::VARCHAR END AS size, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS kind FROM part",
)
def upsert_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = property_graph(spark, sf)
    new = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.lit("new").alias("node_type"), F.create_map(F.lit("kind"), F.col("p_type")).alias("attrs"))
    of = lambda k: F.try_element_at("attrs", F.lit(k)).alias(k)
    return graph.upsert_nodes(nodes.where("node_id LIKE 'p%'"), new, ("size",)).select("node_id", "node_type", of("name"), of("size"), of("kind"))


@query("GRA04_delete_nodes", f"WITH {_EDGES} SELECT * FROM edges WHERE src NOT IN ('s1', 's2') AND dst NOT IN ('s1', 's2')")
def delete_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = property_graph(spark, sf)
    return graph.delete_nodes(nodes, edges, nodes.where("node_id IN ('s1', 's2')"))[1]


@query("GRA07_hop", f"WITH {_EDGES} SELECT src AS origin, dst AS node_id, relation FROM edges WHERE src IN (SELECT 's' || s_suppkey FROM supplier) AND relation IN ('A', 'R')")
def hop(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"))
    return graph.hop(starts.withColumn("origin", F.col("node_id")), property_graph(spark, sf)[1], ("A", "R"))


@query(
    "GRA08_within_two",
    f"""WITH {_EDGES}, st AS (SELECT 'p' || p_partkey AS origin FROM part), one AS (SELECT DISTINCT origin, dst AS node_id FROM st JOIN edges ON src = origin), two AS (SELECT DISTINCT origin, dst AS node_id FROM one JOIN edges ON src = node_id),
    al AS (SELECT origin, node_id, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM one UNION ALL SELECT *, 2 FROM two) WHERE origin != node_id GROUP BY ALL)
    SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY origin ORDER BY depth, node_id) <= 30""",
)
def within_two(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"))
    return graph.within_two(starts.withColumn("origin", F.col("node_id")), property_graph(spark, sf)[1])


_RULES = [("A", 1, ["x"], [], ["z"]), ("A", 2, [], ["a", "e"], []), ("B", 1, [], ["o"], ["q"])]


@query(
    "GRA09_first_rule",
    f"""WITH q AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS intent, text FROM documents), r AS (SELECT * FROM {values(_RULES, 'intent, prio, all_kw, any_kw, none_kw')})
    SELECT query_id, prio FROM q JOIN r USING (intent) WHERE len(list_filter(all_kw, lambda w: NOT contains(text, w))) = 0 AND (len(any_kw) = 0 OR len(list_filter(any_kw, lambda w: contains(text, w))) > 0) AND len(list_filter(none_kw, lambda w: contains(text, w))) = 0
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY prio) = 1""",
)
def first_rule(spark: SparkSession, sf: str) -> DataFrame:
    questions = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("intent"), "text")
    rules = spark.createDataFrame(_RULES, "intent string, prio int, all_kw array<string>, any_kw array<string>, none_kw array<string>")
    return graph.first_rule(questions, rules).select("query_id", "prio")


# ---- course records: an order is a student's, a line a course

_GRADES = list(fixed.GRADE_RANKS)
_COURSES = f"""cs AS (SELECT o_custkey AS student, 'c' || l_partkey AS course, CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE year(l_shipdate) || '-' || (CASE WHEN month(l_shipdate) >= 7 THEN 2 ELSE 1 END) END AS term, l_linenumber::DOUBLE AS credits,
(ARRAY[{', '.join(f"'{g}'" for g in _GRADES)}])[((l_partkey + l_linenumber) % {len(_GRADES)})::INT + 1] AS grade FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_POINTS = "CASE grade " + " ".join(f"WHEN '{g}' THEN {p}" for g, p in fixed.GRADE_POINTS.items()) + " END"
_RANKS = "CASE grade " + " ".join(f"WHEN '{g}' THEN {r}" for g, r in fixed.GRADE_RANKS.items()) + " END"


def courses(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    term = F.when(F.col("l_orderkey") % 11 == 0, "").otherwise(F.concat(F.year("l_shipdate"), F.lit("-"), F.when(F.month("l_shipdate") >= 7, 2).otherwise(1)))
    grade = F.element_at(F.array(*map(F.lit, _GRADES)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(_GRADES)).cast("int") + 1)
    return joined.select(F.col("o_custkey").alias("student"), F.concat(F.lit("c"), "l_partkey").alias("course"), term.alias("term"), F.col("l_linenumber").cast("double").alias("credits"), grade.alias("grade"))


@query("REC01_by_term", f"WITH {_COURSES} SELECT student, term, round(sum(credits), 1) AS credits, count(*) AS courses, round(sum({_POINTS} * credits) / sum(CASE WHEN {_POINTS} IS NOT NULL THEN credits END), 6) AS gpa FROM cs WHERE term != '' GROUP BY ALL")
def by_term(spark: SparkSession, sf: str) -> DataFrame:
    return records.by_term(courses(spark, sf), "student", digits=6)


@query("REC02_grades", f"WITH {_COURSES} SELECT student, regexp_replace(grade, '^([A-D])0$', '\\1') AS grade, count(*) AS n FROM cs GROUP BY ALL")
def grades(spark: SparkSession, sf: str) -> DataFrame:
    return records.grades(courses(spark, sf), "student")


@query("REC03_latest_term", f"WITH {_COURSES} SELECT * FROM (SELECT * FROM cs WHERE term != '') QUALIFY term = max(term) OVER (PARTITION BY student)")
def latest_term(spark: SparkSession, sf: str) -> DataFrame:
    return records.latest_term(courses(spark, sf), "student")


@query("REC04_retakes", f"WITH {_COURSES}, one AS (SELECT student, course, min(grade) AS grade FROM cs GROUP BY ALL), lo AS (SELECT *, {_RANKS} AS grade_rank FROM one) SELECT *, row_number() OVER (PARTITION BY student ORDER BY grade_rank, course) AS place FROM lo WHERE grade_rank BETWEEN 0 AND 7")
def retakes(spark: SparkSession, sf: str) -> DataFrame:
    one = courses(spark, sf).groupBy("student", "course").agg(F.min("grade").alias("grade"))
    return records.retakes(one, "student")


@query(
    "REC05_gaps",
    f"""WITH {_COURSES}, ca AS (SELECT student, grade AS category, 20.0::DOUBLE AS required, sum(credits) AS acquired FROM cs GROUP BY ALL), g AS (SELECT *, round(greatest(0, required - acquired), 6) AS short, acquired >= required AS met, least(100, floor(acquired / required * 100))::BIGINT AS progress FROM ca)
    SELECT *, ceil(short / 18)::BIGINT AS terms_left FROM g""",
)
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    categories = courses(spark, sf).groupBy("student", F.col("grade").alias("category")).agg(F.lit(20.0).alias("required"), F.sum("credits").alias("acquired"))
    return records.projection(records.gaps(categories))
