"""Routing of candidates, and the graph and record operators that work beside it, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import chunking, graph, records, route, tables
from corvane.plans.lifecycle_queries import _COURSES, _EDGES, _NODES, courses, property_graph
from corvane.registry import query
from corvane.session import table
from corvane.sources import html, page_tree

# ---- candidates: a customer is a question, an order a document

_FOUND = """fo AS (SELECT o_custkey AS query_id, o_orderkey AS doc_key, CASE (o_orderkey // 3) % 5 WHEN 0 THEN 'domestic' WHEN 1 THEN 'guide' WHEN 2 THEN 'faq' WHEN 3 THEN 'notice' ELSE 'timetable' END AS doc_type,
  o_orderpriority || (o_orderkey // 7) % 3 AS head, round(o_totalprice, 2) AS score FROM orders),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o_orderdate DESC, doc_key) AS rank FROM (SELECT fo.*, o_orderdate FROM fo JOIN orders ON o_orderkey = doc_key WHERE o_orderstatus = 'F'))"""


def found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    third = F.floor(k / 3) % 5
    kind = F.when(third == 0, "domestic").when(third == 1, "guide").when(third == 2, "faq").when(third == 3, "notice").otherwise("timetable")
    head = F.concat("o_orderpriority", F.floor(k / 7) % 3)
    rows = o.select(F.col("o_custkey").alias("query_id"), k.alias("doc_key"), kind.alias("doc_type"), head.alias("head"), F.round("o_totalprice", 2).alias("score"), "o_orderstatus", "o_orderdate")
    newest = Window.partitionBy("query_id").orderBy(F.desc("o_orderdate"), "doc_key")
    keyword = rows.where("o_orderstatus = 'F'").withColumn("rank", F.row_number().over(newest)).where("rank <= 4").select("query_id", "doc_key", "doc_type", "head", "rank")
    return rows.drop("o_orderstatus", "o_orderdate"), keyword


_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key)"


@query(
    "TOP04_tiered",
    f"""WITH {_FOUND}, p1 AS (SELECT query_id, doc_key, doc_type, head, 1 AS phase, {_BEST} AS place FROM fo WHERE doc_type IN ('domestic', 'faq') QUALIFY place <= 5),
    p2 AS (SELECT query_id, doc_key, doc_type, head, 2 AS phase, {_BEST} AS place FROM fo WHERE query_id NOT IN (SELECT query_id FROM p1 GROUP BY query_id HAVING count(*) >= 3) QUALIFY place <= 5),
    d1 AS (SELECT * FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) QUALIFY phase = 1 OR row_number() OVER (PARTITION BY query_id, head ORDER BY phase, place) = 1),
    hv AS (SELECT query_id, count(*) FILTER (doc_type = 'faq') AS have FROM d1 GROUP BY query_id),
    p3 AS (SELECT query_id, doc_key, doc_type, head, 3 AS phase, {_BEST} AS place FROM fo WHERE doc_type = 'faq' QUALIFY place <= 5),
    n3 AS (SELECT * FROM (SELECT * FROM (SELECT * FROM d1 UNION ALL SELECT * FROM p3) QUALIFY phase = 1 OR row_number() OVER (PARTITION BY query_id, head ORDER BY phase, place) = 1) WHERE phase = 3),
    m3 AS (SELECT n3.* FROM n3 LEFT JOIN hv USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 2 - coalesce(have, 0)),
    p4 AS (SELECT query_id, doc_key, doc_type, head, 4 AS phase, rank AS place FROM kw WHERE rank <= 4),
    al AS (SELECT * FROM (SELECT * FROM d1 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM p4) QUALIFY phase = 1 OR row_number() OVER (PARTITION BY query_id, head ORDER BY phase, place) = 1)
    SELECT query_id, doc_key, phase, row_number() OVER (PARTITION BY query_id ORDER BY phase, place) AS rank FROM al""",
)
def tiered(spark: SparkSession, sf: str) -> DataFrame:
    return route.tiered(*found(spark, sf), ("domestic", "faq"), 5)


@query("TOP05_needs_rerank", f"WITH {_FOUND} SELECT query_id, doc_key, count(*) OVER (PARTITION BY query_id) > 3 AS rerank FROM kw")
def needs_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = found(spark, sf)
    late = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_key"))
    return route.needs_rerank(rows.join(late, "doc_key")).select("query_id", "doc_key", "rerank")


@query("FIL02_student_types", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0 OR substr(o_orderpriority, 1, 1) IN ('1', '2') OR o_orderkey % 7 = 0")
def student_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of a row: none, those of its priority, or the wanted one beside another."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    types = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 7 == 0, F.array(F.lit("x"), F.lit("low"))).otherwise(F.array(F.when(F.substring(p, 1, 1).isin("1", "2"), "low").otherwise("high")))
    rows = table(spark, sf, "orders").withColumn("types", types)
    return rows.where(route.allowed_types(rows, "types", F.lit("low"))).select("o_orderkey", "o_orderpriority")


_TEXTS = "tx AS (SELECT doc_id, (doc_id // 7) AS query_id, CASE WHEN doc_id % 11 = 0 THEN 'graph' ELSE 'vector' END AS channel, text, (doc_id // 7) % 2 = 0 AS asked, CASE WHEN (doc_id // 7) % 3 = 0 THEN 'SCHOLARSHIP' ELSE 'SCHEDULE' END AS intent FROM documents WHERE text IS NOT NULL)"
_TOPIC = ("tion", "ung")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    group = F.floor(F.col("doc_id") / 7)
    kind = F.when(group % 3 == 0, "SCHOLARSHIP").otherwise("SCHEDULE")
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", group.alias("query_id"), F.when(F.col("doc_id") % 11 == 0, "graph").otherwise("vector").alias("channel"), "text", (group % 2 == 0).alias("asked"), kind.alias("intent"))


_ANY = lambda column: "(" + " OR ".join(f"contains({column}, '{w}')" for w in _TOPIC) + ")"


@query("FIL04_on_topic", f"WITH {_TEXTS}, k AS (SELECT *, NOT asked OR channel = 'graph' OR {_ANY('lower(text)')} AS keep FROM tx) SELECT query_id, doc_id FROM k QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY query_id)")
def on_topic(spark: SparkSession, sf: str) -> DataFrame:
    return route.on_topic(_texts(spark, sf), _TOPIC, F.col("asked")).select("query_id", "doc_id")


@query("FIL05_off_topic", f"WITH {_TEXTS}, k AS (SELECT *, asked OR channel = 'graph' OR NOT {_ANY('substr(lower(text), 1, 200)')} AS keep FROM tx) SELECT query_id, doc_id FROM k QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY query_id)")
def off_topic(spark: SparkSession, sf: str) -> DataFrame:
    return route.off_topic(_texts(spark, sf), _TOPIC, F.col("asked")).select("query_id", "doc_id")


@query("TOP16_by_focus", f"WITH {_TEXTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM tx) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 3 AND intent = 'SCHOLARSHIP' AND (contains(text, '장학') OR contains(text, 'TA')) THEN 0 ELSE 1 END, rank) AS rank FROM r")
def by_focus(spark: SparkSession, sf: str) -> DataFrame:
    rows = _texts(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return route.by_focus(rows, F.col("intent")).select("query_id", "doc_id", "rank")


# ---- the graph


@query("AGG05_node_counts", f"WITH {_NODES} SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type")
def node_counts(spark: SparkSession, sf: str) -> DataFrame:
    return property_graph(spark, sf)[0].groupBy("node_type").agg(F.count("*").alias("n"))


@query("GRA05_nodes_of_type", f"WITH {_NODES} SELECT node_id, node_type FROM nodes WHERE node_type = 'supplier'")
def nodes_of_type(spark: SparkSession, sf: str) -> DataFrame:
    return property_graph(spark, sf)[0].where("node_type = 'supplier'").select("node_id", "node_type")


_NEW_EDGES = "ne AS (SELECT DISTINCT 's' || ps AS src, 'p' || pp AS dst, 'X' AS relation FROM (SELECT l_suppkey AS ps, l_partkey AS pp FROM lineitem WHERE l_orderkey % 5 = 0))"


@query("GRA03_upsert_edges", f"WITH {_EDGES}, {_NEW_EDGES} SELECT src, dst, coalesce(ne.relation, edges.relation) AS relation FROM edges FULL JOIN ne USING (src, dst)")
def upsert_edges(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "lineitem").where("l_orderkey % 5 = 0").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("X").alias("relation")).distinct()
    return graph.upsert_edges(property_graph(spark, sf)[1], new)


@query("JOI15_tagged_edges", f"WITH {_NODES}, {_EDGES}, t AS (SELECT 's' || s_suppkey AS src, unnest(CASE WHEN s_nationkey % 2 = 0 THEN ['a', 'b'] ELSE ['b'] END) AS tag FROM supplier), m AS (SELECT * FROM (VALUES ('a', 'Brand#11'), ('b', 'Brand#22')) AS m(tag, node_type)) SELECT DISTINCT src, node_id AS dst, 'TAGGED' AS relation FROM t JOIN m USING (tag) JOIN nodes USING (node_type) WHERE (src, node_id) NOT IN (SELECT (src, dst) FROM edges)")
def tagged_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = property_graph(spark, sf)
    tags = F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    tagged = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), tags.alias("tags"))
    mapping = spark.createDataFrame([("a", "Brand#11"), ("b", "Brand#22")], "tag string, node_type string")
    return graph.tagged_edges(tagged, mapping, nodes, edges, "TAGGED")


@query("JOI21_with_fallback", "SELECT l_orderkey, l_linenumber, coalesce(a.s_name, b.s_name) AS name FROM lineitem LEFT JOIN supplier a ON l_suppkey + 30 * l_linenumber = a.s_suppkey LEFT JOIN supplier b ON l_suppkey % 50 = b.s_suppkey")
def with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return graph.with_fallback(lines, F.col("l_suppkey") + 30 * F.col("l_linenumber"), F.col("l_suppkey") % 50, names, "name").select("l_orderkey", "l_linenumber", "name")


@query("AGG32_field_report", f"WITH {_NODES}, ty AS (SELECT DISTINCT node_type FROM nodes WHERE node_type <> 'supplier') SELECT node_type, 'name' AS field, 'unseen' AS kind FROM ty UNION ALL SELECT 'supplier', 'region', 'missing'")
def field_report(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = property_graph(spark, sf)
    brands = nodes.where("node_type != 'supplier'").select("node_type").distinct().select("node_type", F.lit("size").alias("field"), F.lit(True).alias("required"))
    own = spark.createDataFrame([("supplier", "name", True), ("supplier", "region", True)], "node_type string, field string, required boolean")
    return tables.field_report(nodes, brands.unionByName(own))


# ---- course records

_SNAPSHOTS = f"""{_COURSES}, c1 AS (SELECT student || course AS course, term, min(grade) AS grade FROM cs GROUP BY ALL), od AS (SELECT * FROM c1 WHERE length(course) % 4 <> 0), nw AS (SELECT course, term, CASE WHEN course LIKE '%3' THEN 'A+' WHEN course LIKE '%5' THEN '' ELSE grade END AS grade FROM c1)"""


@query(
    "JOI17_record_changes",
    f"WITH {_SNAPSHOTS} SELECT nw.course, nw.term, CASE WHEN od.course IS NULL THEN 'new' ELSE 'grade' END AS change, od.grade AS old_grade, nw.grade AS new_grade FROM nw LEFT JOIN od USING (course, term) WHERE od.course IS NULL OR (nw.grade <> '' AND nw.grade <> od.grade)",
)
def record_changes(spark: SparkSession, sf: str) -> DataFrame:
    one = courses(spark, sf).groupBy(F.concat("student", "course").alias("course"), "term").agg(F.min("grade").alias("grade"))
    changed = F.when(F.col("course").endswith("3"), "A+").when(F.col("course").endswith("5"), "").otherwise(F.col("grade"))
    return records.record_changes(one.where(F.length("course") % 4 != 0), one.withColumn("grade", changed))


def action_rules() -> dict:
    acquired, gpa, failed = map(F.col, ("acquired", "gpa", "failed"))
    return {
        "credits_short": ("error", acquired < 60, 60 - acquired),
        "low_average": ("warn", gpa < 2.0, gpa),
        "many_failed": ("warn", failed >= 3, failed),
        "close_to_done": ("info", (acquired >= 60) & (acquired < 80), 80 - acquired),
    }


_POINTS = "CASE grade WHEN 'A+' THEN 4.5 WHEN 'A' THEN 4.0 WHEN 'A0' THEN 4.0 WHEN 'B+' THEN 3.5 WHEN 'B' THEN 3.0 WHEN 'B0' THEN 3.0 WHEN 'F' THEN 0.0 ELSE 1.0 END"


@query(
    "AGG15_actions",
    f"""WITH {_COURSES}, su AS (SELECT student, sum(credits) AS acquired, round(avg({_POINTS}), 6) AS gpa, count(*) FILTER (grade = 'F') AS failed FROM cs GROUP BY student),
    al AS (SELECT student, 'credits_short' AS rule, 'error' AS severity, 0 AS o, 60 - acquired AS value FROM su WHERE acquired < 60 UNION ALL SELECT student, 'low_average', 'warn', 1, gpa FROM su WHERE gpa < 2.0
      UNION ALL SELECT student, 'many_failed', 'warn', 1, failed FROM su WHERE failed >= 3 UNION ALL SELECT student, 'close_to_done', 'info', 2, 80 - acquired FROM su WHERE acquired >= 60 AND acquired < 80)
    SELECT student, rule, severity, round(value::DOUBLE, 6) AS value, row_number() OVER (PARTITION BY student ORDER BY o, rule) AS place FROM al""",
)
def actions(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("grade")
    points = F.when(g == "A+", 4.5).when(g.isin("A", "A0"), 4.0).when(g == "B+", 3.5).when(g.isin("B", "B0"), 3.0).when(g == "F", 0.0).otherwise(1.0)
    summary = courses(spark, sf).groupBy("student").agg(F.sum("credits").alias("acquired"), F.round(F.avg(points), 6).alias("gpa"), F.count_if(g == "F").alias("failed"))
    return records.actions(summary, "student", action_rules())


# ---- rows of a day


@query(
    "TOP31_islands",
    """WITH d AS (SELECT DISTINCT o_custkey, (o_orderdate::DATE - DATE '1992-01-01') // 30 AS period FROM orders), g AS (SELECT *, period - row_number() OVER (PARTITION BY o_custkey ORDER BY period) AS island FROM d)
    SELECT o_custkey, min(period) AS first, max(period) AS last, count(*) AS periods FROM g GROUP BY o_custkey, island""",
)
def islands(spark: SparkSession, sf: str) -> DataFrame:
    periods = table(spark, sf, "orders").select("o_custkey", F.floor(F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1992-01-01"))) / 30).alias("period"))
    return tables.islands(periods, "o_custkey", "period").withColumnsRenamed({"first_value": "first", "last_value": "last"})


@query("TOP35_next_ids", "SELECT strftime(o_orderdate, '%Y%m%d') AS day, 'faq-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad((max(k) + 1)::VARCHAR, 4, '0') AS next_id FROM (SELECT o_orderdate, o_orderkey % 1000 AS k FROM orders) GROUP BY strftime(o_orderdate, '%Y%m%d')")
def next_ids(spark: SparkSession, sf: str) -> DataFrame:
    taken = table(spark, sf, "orders").select(F.concat(F.lit("faq-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0")).alias("id"))
    return tables.next_ids(taken, "id")


@query("SNK04_delete_by_type", "SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src2'")
def delete_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return tables.delete_by_type(table(spark, sf, "documents"), "source", "src2").select("doc_id", "source")


@query(
    "SET05_source_urls",
    "SELECT query_id, url, min(rank) AS rank FROM (SELECT page_id % 20 AS query_id, url, page_id AS rank FROM pages WHERE page_id % 3 <> 0 AND (url LIKE 'http://%' OR url LIKE 'https://%')) GROUP BY ALL",
)
def source_urls(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select((F.col("page_id") % 20).alias("query_id"), "url", F.col("page_id").alias("rank"), F.when(F.col("page_id") % 3 != 0, "notice").otherwise("faq").alias("doc_type"))
    return tables.source_urls(rows, ("notice", "notice_attachment"))


@query("CHK06_table_pieces")
def table_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as the bodies of tables; the cut is a fold, so tested against a plain model."""
    body = F.regexp_replace("text", r"[.!?] ", " |\n| ")
    md = F.concat(F.lit("| a | b |\n|---|---|\n| "), body)
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(chunking.table_pieces(md)).alias("pos", "piece"))


@query("CHK10_trimmed_sections", "SELECT doc_id, md5(CASE WHEN cut >= 100 THEN substr(text, 1, cut) ELSE text END) AS digest FROM (SELECT doc_id, text, coalesce(least(CASE WHEN instr(text, 'xer') > 0 THEN instr(text, 'xer') END, CASE WHEN instr(text, 'oli') > 0 THEN instr(text, 'oli') END), 0) - 1 AS cut FROM documents WHERE text IS NOT NULL)")
def trimmed_sections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(chunking.trimmed(F.col("text"), ("xer", "oli"))).alias("digest"))


# ---- web pages: parsed in Python, so tested against written-out pages


@query("SRC14_visible_texts")
def visible_texts(spark: SparkSession, sf: str) -> DataFrame:
    return html.page_texts(table(spark, sf, "pages"))


@query("SRC15_main_texts")
def main_texts(spark: SparkSession, sf: str) -> DataFrame:
    return html.page_texts(table(spark, sf, "pages"), main_only=True)


@query("SRC17_sections")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    return page_tree.page_sections(table(spark, sf, "pages"))


_LINES = "li AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem)"


@query(
    "SRC18_table_fields",
    f"""WITH {_LINES} SELECT k AS order_key, 0 AS table, 2 * (r - 1) + c AS seq, (CASE c WHEN 0 THEN 'line' ELSE 'part' END) || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS name, (CASE c WHEN 0 THEN n ELSE p END)::VARCHAR AS value FROM li, range(2) t(c) WHERE k % 3 = 0
    UNION ALL SELECT k, 0, 0, 'part', string_agg(p::VARCHAR, ' / ' ORDER BY r) FROM li WHERE k % 3 = 1 GROUP BY k UNION ALL SELECT k, 0, r - 1, '내용_' || r, n || ' ' || p FROM li WHERE k % 3 = 2""",
)
def fields_of_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's lines as a table of one of the three layouts, and the fields read from it."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")))).alias("lines"))
    row = lambda form: F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<tr>"), form(x), F.lit("</tr>"))), "")
    cell = lambda x, tag="td": F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    both = row(lambda x: F.concat(cell(x["n"]), cell(x["p"])))
    layout = F.col("l_orderkey") % 3
    body = F.when(layout == 0, F.concat(F.lit("<tr><th>line</th><th> part</th></tr>"), both)).when(layout == 1, row(lambda x: F.concat(F.lit("<th>part</th>"), cell(x["p"])))).otherwise(both)
    return page_tree.page_fields(lines.select(F.col("l_orderkey").alias("order_key"), F.concat(F.lit("<body><table>"), body, F.lit("</table>")).alias("html")), "order_key")


@query(
    "SRC19_board_posts",
    """WITH po AS (SELECT o_custkey AS board, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, o_orderkey, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS posted, o_orderstatus = 'P' AS pinned FROM orders),
    st AS (SELECT board, min(seq) AS stop FROM po WHERE NOT pinned AND posted < DATE '1993-06-01' GROUP BY board)
    SELECT board, seq, 'http://board/b?bo_table=n&id=' || o_orderkey AS url, title, posted, pinned FROM po LEFT JOIN st USING (board) WHERE stop IS NULL OR seq < stop""",
)
def board_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as a board's list, open ones pinned, and the posts read from it up to the first old one."""
    o = table(spark, sf, "orders")
    number = F.when(F.col("o_orderstatus") == "P", "notice").otherwise(F.col("o_orderkey").cast("string"))
    row = F.concat(F.lit("<tr><td class='td_num'>"), number, F.lit("</td><td class='td_subject'><a href='/b?bo_table=n&amp;id="), "o_orderkey", F.lit("'>"), "o_orderpriority", F.lit("</a></td><td class='td_date'>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</td></tr>"))
    rows = o.select(F.col("o_custkey").alias("board"), F.struct("o_orderkey", row.alias("row")).alias("r")).groupBy("board").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    pages = rows.select("board", F.concat(F.lit("<body><div class='tbl_wrap'><table><tbody>"), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</tbody></table></div>")).alias("html"))
    return page_tree.list_posts(pages, F.lit("1993-06-01").cast("date"), "board", base="http://board/list", board="bo_table=n")
