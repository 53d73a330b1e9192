"""Text functions over documents, pages, orders and literal Korean cases, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import fixed, text
from corvane.registry import query, values
from corvane.session import table

_S = text.SUFFIX.replace("'", "''")
_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_STEMS = f"list_filter(list_transform(regexp_extract_all(text, '{text.TOKEN}'), lambda t: regexp_replace(t, '{_S}', '\\1')), lambda t: length(t) >= 2)"

CASES = [
    (1, "졸업에 필요한 학점은 몇 학점인가요?", "2021~2023학번은 130학점 이상 이수"),
    (2, "수강신청기간은 언제까지입니까", "2024학번 이후 2026-03-02 신청"),
    (3, "복수전공신청 방법을 알려주세요", "2023학번까지 서류 제출 https://example.com/a"),
    (4, "the tuition and 장학금의 차이", "2019학번과 2022학번 공통"),
    (5, "휴학하고 복학하려면 어떻게 해야 하나요", "2022학년도부터 적용, 최대 3년"),
    (6, "OCU 수강료는 얼마", "2020 - 2022 절차 안내"),
    (7, "Where is the office", "공통 내용"),
    (8, "", ""),
    (9, "123 !!", "2024학번부터 2026년"),
    (10, "전화번호 연락처 사이트 주소", "자세한 내용은 홈페이지 > 공지 참고"),
    (11, "성적 등급은 몇 과목 몇시 어디", "18학점 120,000원 3과목 10:30 051-509-5182 http://a.b/c"),
    (12, "로그인이 안 돼요 오류", "8월 21일까지 문의 바랍니다"),
]
_CASES = values(CASES, "id, text, body")


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, "id int, text string, body string")


@query(
    "SCA_tokens_documents",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{text.TOKEN}') AS tk, {_STEMS} AS st FROM documents)
    SELECT doc_id, len(tk) AS n_tokens, len(st) AS n_stems, len(list_filter(st, lambda w: NOT list_contains({_LIST(fixed.SEARCH_STOPWORDS)}, w))) AS n_search,
           len(list_distinct(st)) AS n_distinct, array_to_string(tk[1:5], ' ') AS head FROM t""",
)
def tokens_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("tk"), text.stems(F.col("text")).alias("st"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), F.size("st").cast("long").alias("n_stems"), F.size(text.without(F.col("st"), fixed.SEARCH_STOPWORDS)).cast("long").alias("n_search"), F.size(F.array_distinct("st")).cast("long").alias("n_distinct"), F.array_join(F.slice("tk", 1, 5), " ").alias("head"))


@query(
    "SCA_profile_documents",
    r"""SELECT doc_id, CASE WHEN la = 0 THEN 'ko' WHEN ko / la >= 0.3 THEN 'ko' ELSE 'en' END AS language, round(bad / greatest(1, n), 6) AS garbage,
      round(bad / greatest(1, n - md), 6) AS table_garbage, norm_len,
      CASE WHEN regexp_matches(text, '\d{4}[-./]\d{1,2}[-./]\d{1,2}') THEN 'schedule' WHEN regexp_matches(text, 'https?://') THEN 'contact'
           WHEN regexp_matches(text, '\d+학점|이상|이하|최대|최소|초과') THEN 'requirement' WHEN regexp_matches(text, '신청|절차|방법|제출|서류') THEN 'procedure' ELSE 'general' END AS info_type
    FROM (SELECT doc_id, text, length(text) AS n, (length(text) - length(regexp_replace(text, '[a-zA-Z가-힣]', '', 'g')))::DOUBLE AS la,
      (length(text) - length(regexp_replace(text, '[가-힣ㄱ-ㅎㅏ-ㅣ]', '', 'g')))::DOUBLE AS ko, (length(text) - length(regexp_replace(text, '"""
    + text.GARBAGE
    + r"""', '', 'g')))::DOUBLE AS bad,
      length(text) - length(regexp_replace(text, '[|\-\s]', '', 'g')) AS md, length(lower(regexp_replace(text, '[\s\-.,:()\[\]/~·]', '', 'g'))) AS norm_len FROM documents)""",
)
def profile_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.language(c).alias("language"), F.round(text.garbage_ratio(c), 6).alias("garbage"), F.round(text.garbage_ratio(c, True), 6).alias("table_garbage"), F.length(text.normalized(c)).cast("long").alias("norm_len"), text.info_type(c).alias("info_type"))


@query(
    "SCA_korean_cases",
    f"""WITH s AS (SELECT id, text, regexp_extract_all(text, '{text.TOKEN}') AS tk, {_STEMS} AS st FROM {_CASES}),
    m AS (SELECT id, list_distinct(list_filter(flatten(list_transform(st, lambda t: CASE WHEN length(t) >= 4 THEN list_concat([t], list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) ELSE [t] END)), lambda w: NOT list_contains({_LIST(fixed.QUESTION_STOPWORDS)}, w))) AS mt FROM s)
    SELECT id, array_to_string(tk, ' ') AS tokens, array_to_string(st, ' ') AS stems, array_to_string(list_filter(st, lambda w: NOT list_contains({_LIST(fixed.QUESTION_STOPWORDS)}, w)), ' ') AS core,
           array_to_string(list_filter(st, lambda w: NOT list_contains({_LIST(fixed.SEARCH_STOPWORDS)}, w)), ' ') AS search, array_to_string(list_sort(mt), ' ') AS parts FROM s JOIN m USING (id)""",
)
def korean_cases(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    join = lambda x, name: F.array_join(x, " ").alias(name)
    return _cases(spark).select("id", join(text.tokens(c), "tokens"), join(text.stems(c), "stems"), join(text.core_tokens(c), "core"), join(text.search_tokens(c), "search"), join(F.array_sort(text.match_tokens(c)), "parts"))


_YEAR = lambda p, g=1: f"TRY_CAST(nullif(regexp_extract(body, '{p}', {g}), '') AS INTEGER)"


def _cohort_sql(order: list[tuple[str, str]]) -> str:
    kinds = {
        "both": lambda p: (f"regexp_matches(body, '{p}')", _YEAR(p), _YEAR(p, 2)),
        "after": lambda p: (f"regexp_matches(body, '{p}')", _YEAR(p), "2030"),
        "before": lambda p: (f"regexp_matches(body, '{p}')", "2016", _YEAR(p)),
        "named": lambda p: (f"len(regexp_extract_all(body, '{p}')) > 0", f"list_min(regexp_extract_all(body, '{p}', 1))::INTEGER", f"list_max(regexp_extract_all(body, '{p}', 1))::INTEGER"),
    }
    cases = [kinds[k](p) for k, p in order]
    return tuple("CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + f" ELSE {default} END" for i, default in ((1, 2016), (2, 2030)))


_PAGE = _cohort_sql([("both", "(20[0-9]{2})[~·](20[0-9]{2})학번"), ("after", r"(20[0-9]{2})학번\s*(?:이후|부터)"), ("before", r"(20[0-9]{2})학번\s*(?:이전|까지)"), ("named", "(201[6-9]|202[0-9])학번")])
_CHUNK = _cohort_sql([("named", r"(20[0-9]{2})\s*학번"), ("after", r"(20[0-9]{2})\s*(?:학년도부터|학번\s*이후|이후|학년도\s*이후)"), ("before", r"(20[0-9]{2})\s*(?:학번\s*이전|학번까지|이전)"), ("both", r"(20[0-9]{2})\s*[~\-]\s*(20[0-9]{2})")])


@query("SCA_cohort_cases", f"SELECT id, {_PAGE[0]} AS page_from, {_PAGE[1]} AS page_to, {_CHUNK[0]} AS chunk_from, {_CHUNK[1]} AS chunk_to FROM {_CASES}")
def cohort_cases(spark: SparkSession, sf: str) -> DataFrame:
    page, chunk = text.cohort_of_page(F.col("body")), text.cohort_of_chunk(F.col("body"))
    return _cases(spark).select("id", page["from"].alias("page_from"), page["to"].alias("page_to"), chunk["from"].alias("chunk_from"), chunk["to"].alias("chunk_to"))


_ANY = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query(
    "SCA_answer_signs",
    f"""SELECT id, {_ANY("lower(text)", fixed.TROUBLE_SIGNS)} AS trouble, {_ANY("substr(body, 1, 120)", fixed.REDIRECT_MARKERS)} AND NOT regexp_matches(substr(body, 1, 120), '{fixed.CONCRETE}') AS redirect,
        {_ANY("body", fixed.NO_CONTEXT)} AS refusal, array_to_string(list_filter([{", ".join(f"CASE WHEN {_ANY('full_text', w)} THEN '{t}' END" for t, w in fixed.TAGS.items())}], lambda x: x IS NOT NULL), ',') AS tags
    FROM (SELECT id, text, body, text || ' ' || substr(body, 1, 300) AS full_text FROM {_CASES})""",
)
def answer_signs(spark: SparkSession, sf: str) -> DataFrame:
    t, b = F.col("text"), F.col("body")
    return _cases(spark).select("id", text.reports_trouble(t).alias("trouble"), text.is_redirect(b, F.lit("")).alias("redirect"), text.is_refusal(b).alias("refusal"), F.array_join(text.tags(t, b), ",").alias("tags"))


_UNITS = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN {_ANY('lower(text)', w)} THEN {_LIST(u)} ELSE [] END" for w, u in fixed.UNIT_TRIGGERS) + "])))"


@query(
    "GAT_units",
    f"""SELECT id, array_to_string(CASE WHEN len(u) = 0 AND contains(lower(text), '얼마') THEN ['won'] ELSE u END, ',') AS expected,
        {", ".join(f"array_to_string(list_transform(regexp_extract_all(body, '{p}', 1), lambda x: trim(x)), '|') AS {n}_values" for n, p in fixed.UNIT_PATTERNS.items())}
    FROM (SELECT id, text, body, {_UNITS} AS u FROM {_CASES})""",
)
def units(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark).select("id", F.array_join(text.expected_units(F.col("text")), ",").alias("expected"), *(F.array_join(text.unit_values(F.col("body"), n), "|").alias(f"{n}_values") for n in fixed.UNIT_PATTERNS))


ANSWERS = [
    (1, "졸업에는 130학점이 필요합니다 [출처: 12]", "총 130학점 이수"),
    (2, "졸업에는 140학점이 필요합니다", "총 130학점 이수"),
    (3, "관련 정보를 찾을 수 없습니다", "x"),
    (4, "   ", "x"),
    (5, "18학점과 9학점 [p.3]", "18 and 9"),
]


@query(
    "GAT_validator",
    f"""SELECT id, CASE WHEN trim(answer) = '' THEN false WHEN refusal THEN true ELSE len(missing) = 0 END AS passed, array_to_string(CASE WHEN trim(answer) = '' OR refusal THEN [] ELSE missing END, ',') AS missing,
        trim(answer) <> '' AND NOT refusal AND NOT regexp_matches(answer, '\\[(?:출처|p\\.|페이지)[:\\s]*(\\d+)\\]') AS no_source
    FROM (SELECT id, answer, {_ANY("answer", fixed.NO_CONTEXT)} AS refusal, list_filter(regexp_extract_all(answer, '(\\d+)\\s*학점', 1), lambda x: NOT list_contains(regexp_extract_all(context, '\\d+'), x)) AS missing
          FROM {values(ANSWERS, "id, answer, context")})""",
)
def validator(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.createDataFrame(ANSWERS, "id int, answer string, context string")
    missing = F.filter(F.regexp_extract_all("answer", F.lit(r"(\d+)\s*학점"), F.lit(1)), lambda x: ~F.array_contains(F.regexp_extract_all("context", F.lit(r"\d+"), F.lit(0)), x))
    empty, refusal = F.trim("answer") == "", text.is_refusal(F.col("answer"))
    return a.select(
        "id",
        F.when(empty, False).when(refusal, True).otherwise(F.size(missing) == 0).alias("passed"),
        F.array_join(F.when(empty | refusal, F.array().cast("array<string>")).otherwise(missing), ",").alias("missing"),
        (~empty & ~refusal & ~F.col("answer").rlike(r"\[(?:출처|p\.|페이지)[:\s]*(\d+)\]")).alias("no_source"),
    )


@query(
    "SCA_dates_orders",
    """SELECT o_orderdate, CASE WHEN month(o_orderdate) >= 9 THEN make_date(year(o_orderdate), 9, 1) WHEN month(o_orderdate) >= 2 THEN make_date(year(o_orderdate), 2, 20) ELSE make_date(year(o_orderdate) - 1, 9, 1) END AS term_start,
       CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) || '-2' WHEN month(o_orderdate) >= 2 THEN year(o_orderdate) || '-1' ELSE (year(o_orderdate) - 1) || '-2' END AS term,
       make_date(year(o_orderdate), 3, 1) AS valid_from, make_date(year(o_orderdate) + 1, 2, 28) AS valid_to, count(*) AS n FROM orders GROUP BY o_orderdate""",
)
def dates_orders(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    year = text.academic_year(F.year(d).cast("string"))
    return table(spark, sf, "orders").groupBy("o_orderdate").agg(F.count("*").alias("n")).select("o_orderdate", text.term_start(d).cast("date").alias("term_start"), text.term_label(d).alias("term"), year["from"].alias("valid_from"), year["to"].alias("valid_to"), "n")


POSTED = [(1, "2026. 03. 19"), (2, "2026-03-19"), (3, "26-03-19"), (4, "bad"), (5, "2026-13-40"), (6, " 26.1.5 ")]


@query(
    "SCA_post_dates",
    f"""SELECT id, CASE WHEN regexp_matches(p, '^([0-9]{{2}}|[0-9]{{4}})-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN TRY_CAST(try_strptime(CASE WHEN regexp_matches(p, '^[0-9]{{2}}-') THEN '20' || p ELSE p END, '%Y-%m-%d') AS DATE) END AS day
    FROM (SELECT id, regexp_replace(regexp_replace(regexp_replace(trim(s), '[\\s.]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS p FROM {values(POSTED, "id, s")})""",
)
def post_dates(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(POSTED, "id int, s string").select("id", text.post_date(F.col("s")).alias("day"))


YEARS = [(1, "2025"), (2, "2023"), (3, "2022"), (4, "2021"), (5, "2018"), (6, "2012"), (7, None), (8, "abc")]


@query(
    "SCA_year_groups",
    f"""SELECT id, g AS student_group, CASE WHEN g IN ('2023', '2024_2025') THEN '2023이후' ELSE '2022이전' END AS registration_group, CASE WHEN y IS NOT NULL AND 2026 - y + 1 BETWEEN 1 AND 6 THEN 2026 - y + 1 END AS grade
    FROM (SELECT id, y, CASE WHEN y IS NULL THEN '2023' WHEN y >= 2024 THEN '2024_2025' WHEN y >= 2021 THEN y::VARCHAR WHEN y >= 2017 THEN '2017_2020' ELSE '2016_before' END AS g FROM (SELECT id, TRY_CAST(s AS INTEGER) AS y FROM {values(YEARS, "id, s")}))""",
)
def year_groups(spark: SparkSession, sf: str) -> DataFrame:
    y = F.lit(2026) - F.col("s").try_cast("int") + 1
    return spark.createDataFrame(YEARS, "id int, s string").select("id", text.student_group(F.col("s")).alias("student_group"), text.registration_group(F.col("s")).alias("registration_group"), F.when(y.between(1, 6), y).alias("grade"))


@query(
    "SCA_urls_pages",
    r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END || regexp_extract(url, '(#.*)$', 1) AS source_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme
    FROM (SELECT page_id, url, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^page(=|$)'))) AS ps FROM pages)""",
)
def urls_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.normalized_url(F.col("url")).alias("source_id"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"))


@query(
    "SRC_page_titles",
    r"""SELECT page_id, CASE WHEN trim(t1) <> '' THEN trim(t1) WHEN trim(t2) <> '' THEN trim(t2) ELSE url END AS title, length(html)::BIGINT AS n_chars
    FROM (SELECT page_id, url, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t1, regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS t2 FROM pages)""",
)
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    t1 = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    t2 = F.trim(F.regexp_replace(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))
    return table(spark, sf, "pages").select("page_id", F.when(t1 != "", t1).when(t2 != "", t2).otherwise(F.col("url")).alias("title"), F.length("html").cast("long").alias("n_chars"))


BROKEN = [(1, "a\x01b   c     d"), (2, "x<br/>y <B>bold</b> <AI센터>"), (3, "e\u0301 tail \u3401"), (4, "\ue000 point \u02b0"), (5, "")]
_REPAIRED = "s"
for _pattern, _new in text.REPAIRS:
    _REPAIRED = f"regexp_replace({_REPAIRED}, '{_pattern}', '{_new}', 'g')"


@query(
    "SCA_repairs",
    f"SELECT id, {_REPAIRED} AS repaired, regexp_replace(regexp_replace(s, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</?(?:b|i|u|em|strong|sub|sup|small|big|s|mark|del|ins)\\s*/?>', '', 'g') AS plain FROM {values(BROKEN, 'id, s')}",
)
def repairs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(BROKEN, "id int, s string").select("id", text.repaired(F.col("s")).alias("repaired"), text.without_ocr_markup(F.col("s")).alias("plain"))
