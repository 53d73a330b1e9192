"""Answer gates over literal cases and over the turns of the conversations, each with a twin made from the same fixed values.

DuckDB's patterns can't look around; the twins take the sign before or after a value along and cut it off.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import answers, fixed, text
from corvane.registry import query, values
from corvane.session import table

QUESTIONS = (
    "2025 전기 학위수여식 언제인가요", "2023학번 졸업학점 몇 학점", "수강료 얼마예요", "초과 수강료 비용", "컴퓨터공학과 전화번호 알려줘", "영어학부 사무실 어디", "ocu 개강 언제", "재수강 가능 성적", "재수강 기준 성적", "재수강 제한 기준", "출석 요건", "수강신청 마감 시간 몇 시",
    "이론 실습 이수과목", "복수전공 이수학점", "장학금 자격 요건", "신청 방법 알려줘", "1학기 휴학 가능한가요", "안녕하세요", "", "2024~2025 일정",
)
ANSWERS = (
    "2025년 8월 20일 후기 학위수여식입니다", "2025 전기 학위수여식은 2월 14일입니다  ", "2024학번은 120학점, 2023학번은 130학점", "2023학번 130학점이며 36학점은 전공입니다", "120,000원입니다.", "051-509-5501 로 연락하세요", "사무실은 B301-2 입니다", "https://sugang.example.ac.kr 에서 신청",
    "C+이하 과목", "A+ 등급 이상", "자격 요건은 평점 3.0 이상", "기간은 3월 2일부터", "2학기 휴학 불가", "1학기 휴학 가능", "", "이론 12학점 실습 3과목", "오전 10시, 3.12. 까지", "담당 부서에 문의하세요",
)
CONTEXTS = (
    "컴퓨터공학과 | B301 | 5501\n영어학부 | C210-1 | 051-509-6602\n수강료 80,000원, 초과 신청 시 120,000원", "재수강기준성적: C+이하\n출석은 3/4 이상\n개강일: 2026-03-02 개강시간: 오전 10시\n수강신청 마감 17:00", "주전공 36학점 제2전공 27학점\n이론 12 실습 3\nhttps://sugang.example.ac.kr 참고 B+ 이상",
    "C 이하 과목은 재수강\n09:30 부터 마감\n2026년 3월", "", "컴퓨터공학과 없음\n영어학부 12345\n최대 18학점 최소 9학점 출석요건 2/3", "시간: 8:15 A100 120000",
)
ENTITIES = ("컴퓨터공학과", None, "영어학부")
_ROWS = [(f"l{i}-{j}", q, a, CONTEXTS[(i * 3 + j) % 7], ENTITIES[(i + j) % 3]) for i, q in enumerate(QUESTIONS) for j, a in enumerate(ANSWERS)]
_COLUMNS = "id, q, a, c, e"
_CASES = f"""ca AS (SELECT * FROM {values(_ROWS, _COLUMNS)} UNION ALL SELECT 'c' || conv_id || '-' || turn, lag(text) OVER w, text, coalesce(lag(text, 2) OVER w, ''), NULL FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
cs AS (SELECT * REPLACE (coalesce(q, '') AS q, coalesce(a, '') AS a) FROM ca)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """(id, q, a, c, e): questions, answers, contexts and entities; of a conversation each turn with the two before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = lambda n: F.coalesce(F.lag("text", n).over(w), F.lit(""))
    turns = table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), before(1).alias("q"), F.coalesce("text", F.lit("")).alias("a"), before(2).alias("c"), F.lit(None).cast("string").alias("e"))
    return spark.createDataFrame(_ROWS, "id string, q string, a string, c string, e string").unionByName(turns)


_LIT = lambda x: "'" + x.replace("'", "''") + "'"
_ANY = lambda x, words: "(" + " OR ".join(f"contains({x}, {_LIT(w)})" for w in words) + ")"
_SET = lambda xs: "[" + ", ".join(map(_LIT, xs)) + "]::VARCHAR[]"
_W = r"[^\p{L}\p{N}_]"


def _values(x: str, unit: str) -> str:
    """The unit's values in x; of dates and rooms the first is right, of those that touch some later ones are lost."""
    if unit in fixed.UNIT_PATTERNS:
        return f"list_transform(regexp_extract_all({x}, '{fixed.UNIT_PATTERNS[unit]}', 1), lambda v: trim(v))"
    if unit == "date":
        either = r"(?:[0-9]{4}\s*년\s*)?[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일|[0-9]{4}\s*년\s*[0-9]{1,2}\s*월|(?:^|[^0-9])[0-9]{1,2}\.[0-9]{1,2}\.?(?:[^0-9]|$)"
        return f"list_transform(regexp_extract_all({x}, '{either}'), lambda v: CASE WHEN contains(v, '월') THEN trim(v) ELSE regexp_extract(v, '[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.?') END)"
    if unit == "room":
        return f"regexp_extract_all({x}, '(?:^|{_W})([A-Z][0-9]{{3}}(?:-[0-9]+)?)(?:{_W}|$)', 1)"
    apart = rf"regexp_replace({x}, '([^\p{{L}}\p{{N}}_+])', '\1\1', 'g')"
    return rf"list_concat(regexp_extract_all({apart}, '(?:^|{_W})([A-Da-d])(?:\+(?:{_W}|$)|[^\p{{L}}\p{{N}}_+]|$)', 1), regexp_extract_all({x}, '(?:^|{_W})([A-Da-d]\+)[\p{{L}}\p{{N}}_]', 1))"


_EXPECTED = "(SELECT CASE WHEN len(u) = 0 AND contains(lower(q), '얼마') THEN ['won'] ELSE u END FROM (SELECT list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN {_ANY('lower(q)', w)} THEN {_SET(u)} ELSE [] END" for w, u in fixed.UNIT_TRIGGERS) + "]))) AS u))"
_PRESENT = "list_filter([" + ", ".join(f"CASE WHEN len({_values('a', u)}) > 0 THEN '{u}' END" for u in sorted(answers.UNITS)) + "], lambda x: x IS NOT NULL)"


def _signs(x: str, name: str) -> str:
    if name == "year_4":
        rest = rf"regexp_replace({x}, '20[0-9]{{2}}\s*학번', '#', 'g')"
        return f"list_distinct(regexp_extract_all({rest}, '(?:^|[^0-9])(20[0-9]{{2}})', 1))"
    return f"list_distinct(regexp_extract_all({x}, '{(fixed.EXACT_SIGNS | fixed.SHARED_SIGNS)[name]}'))"


def _against(name: str) -> str:
    q, a = _signs("q", name), _signs("a", name)
    differ = f"len(list_filter({a}, lambda v: NOT list_contains({q}, v))) > 0" if name in fixed.EXACT_SIGNS else f"NOT list_has_any({q}, {a})"
    return f"len({q}) > 0 AND len({a}) > 0 AND {differ}"


_HAS = lambda x, p: f"regexp_matches({x}, '{p}')"
_SUBJECT = "(" + " OR ".join(_HAS("q", p) for p in fixed.SUBJECT_SIGNS.values()) + ") AND (" + " OR ".join(_HAS("a", p) for p in fixed.SUBJECT_SIGNS.values()) + ") AND NOT (" + " OR ".join(f"({_HAS('q', p)} AND {_HAS('a', p)})" for p in fixed.SUBJECT_SIGNS.values()) + ")"
_MISMATCH = "CASE " + " ".join(f"WHEN {_against(n)} THEN '{n}'" for n in (*fixed.EXACT_SIGNS, *fixed.SHARED_SIGNS)) + f" WHEN {_SUBJECT} THEN 'subject' END"
_REQUIRED = _SET(fixed.REQUIRED_UNITS)
_GATED = f"""gx AS (SELECT *, {_EXPECTED} AS ex, {_PRESENT} AS pr, {_MISMATCH} AS mis FROM cs),
gy AS (SELECT *, list_filter(ex, lambda x: list_contains({_REQUIRED}, x)) AS must, list_filter(ex, lambda x: NOT list_contains({_REQUIRED}, x)) AS may FROM gx),
gz AS (SELECT *, mis IS NULL AND (len(ex) = 0 OR (len(pr) > 0 AND len(list_filter(must, lambda x: NOT list_contains(pr, x))) = 0 AND (len(may) = 0 OR len(must) > 0 OR list_has_any(may, pr)))) AS ok FROM gy)"""


@query("GAT02_present_units", f"WITH {_CASES} SELECT id, array_to_string({_PRESENT}, ',') AS units FROM cs")
def present_units(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("id", F.array_join(answers.present_units(F.col("a")), ",").alias("units"))


@query("GAT03_mismatches", f"WITH {_CASES} SELECT id, {_MISMATCH} AS mismatch FROM cs")
def mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("id", answers.mismatch(F.col("q"), F.col("a")).alias("mismatch"))


@query("GAT04_aligns", f"WITH {_CASES}, {_GATED} SELECT id, ok AS aligns FROM gz")
def aligns(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("id", answers.aligns(F.col("q"), F.col("a")).alias("aligns"))


_FIRST_OF = lambda lines: f"list_filter(list_transform({lines}, lambda l: coalesce(nullif(regexp_extract(l, '{fixed.UNIT_PATTERNS['phone']}', 1), ''), nullif(regexp_extract(l, '(?:^|[^0-9])([0-9]{{4}})(?:[^0-9]|$)', 1), ''))), lambda x: x IS NOT NULL)[1]"
_LINES = "list_filter(string_split(c, chr(10)), lambda l: contains(l, e))"


def _put(form: str, parts: dict[str, str]) -> str:
    return "(" + " || ".join(parts[x] if i % 2 else _LIT(x) for i, x in enumerate(re.split(r"\{(\w+)\}", form))) + ")"


def _note(unit: str, form: str) -> str:
    value = f"{_values('pool', unit)}[1]"
    value = f"coalesce({value}, {_FIRST_OF('ln')})" if unit == "phone" else value
    return f"CASE WHEN list_contains(lacks, '{unit}') THEN {_put(form, {'1': value})} END"


@query(
    "GAT05_filled",
    f"""WITH {_CASES}, {_GATED}, p AS (SELECT *, list_filter(ex, lambda x: NOT list_contains(pr, x)) AS lacks, {_LINES} AS ln FROM gz), r AS (SELECT *, CASE WHEN e IS NULL THEN c WHEN len(ln) > 0 THEN array_to_string(ln, chr(10)) END AS pool FROM p),
    n AS (SELECT *, list_filter([{", ".join(_note(u, f) for u, f in fixed.UNIT_NOTES.items())}], lambda x: x IS NOT NULL) AS notes FROM r)
    SELECT id, array_to_string(lacks, ',') AS missing, CASE WHEN c <> '' AND len(notes) > 0 THEN regexp_replace(a, '\\s+$', '') || chr(10) || chr(10) || '[참고] ' || array_to_string(notes, ' / ') ELSE a END AS filled FROM n""",
)
def filled(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("id", F.array_join(answers.missing_units(F.col("q"), F.col("a")), ",").alias("missing"), answers.filled(F.col("q"), F.col("a"), F.col("c"), F.col("e")).alias("filled"))


_LACKING = {"url": "NOT contains(c, v)", "won": "NOT contains(c, v) AND NOT contains(c, replace(v, ',', ''))", "grade": "NOT contains(c, v)", "credit": "NOT contains(c, v) AND NOT contains(replace(c, ' ', ''), v)"}


@query("GAT06_unsupported", f"WITH {_CASES} SELECT id, CASE WHEN a <> '' AND c <> '' THEN flatten([" + ", ".join(f"list_transform(list_filter({_values('a', u)}, lambda v: {f}), lambda v: '{u}:' || v)" for u, f in _LACKING.items()) + "])[1] END AS unsupported FROM cs")
def unsupported(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("id", answers.unsupported(F.col("a"), F.col("c")).alias("unsupported"))


_TWO = "q <> '' AND (" + " OR ".join("(" + " AND ".join(f"contains(q, {_LIT(w)})" for w in pair) + ")" for pair in fixed.TWO_VALUE_WORDS) + f" OR regexp_matches(q, '{fixed.TWO_VALUE_PATTERN}') OR regexp_matches(c, '{fixed.TWO_VALUE_PATTERN}'))"


@query("GAT07_complete", f"WITH {_CASES} SELECT id, CASE WHEN {_TWO} THEN 2 ELSE 1 END AS value_count, NOT ({_TWO}) OR len({_values('a', 'credit')}) + len({_values('a', 'course')}) >= 2 AS complete FROM cs")
def complete(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("id", answers.value_count(F.col("q"), F.col("c")).alias("value_count"), answers.complete(F.col("q"), F.col("a"), F.col("c")).alias("complete"))


def _facts() -> str:
    more = f"CASE WHEN {_HAS('c', fixed.FACT_MORE)} THEN ' ' || regexp_extract(c, '{fixed.FACT_MORE}', 1) ELSE '' END"
    found = []
    for groups, none, patterns in fixed.FACT_RULES:
        asked = " AND ".join([*(_ANY("aq", g) for g in groups), *([f"NOT {_ANY('aq', none)}"] if none else [])])
        for pattern, form in patterns:
            parts = {str(i): f"regexp_extract(c, '{pattern}', {i})" for i in (1, 2)} | {"more": f"({more})"}
            found.append(f"CASE WHEN {asked} AND {_HAS('c', pattern)} THEN {_put(form, parts)} END")
    room = f"list_filter(list_transform({_LINES}, lambda l: nullif(regexp_extract(l, '(?:^|{_W})([A-Z][0-9]{{3}}(?:-[0-9]+)?)(?:{_W}|$)', 1), '')), lambda x: x IS NOT NULL)[1]"
    reach = f"list_filter([{_put(fixed.REACH_PHONE, {'1': _FIRST_OF(_LINES)})}, {_put(fixed.REACH_ROOM, {'1': room})}], lambda x: x IS NOT NULL)"
    return f"coalesce({', '.join(found)}, CASE WHEN {_ANY('aq', fixed.REACH_WORDS)} AND len({reach}) > 0 THEN e || '의 ' || array_to_string({reach}, ', ') || '입니다.' END)"


_FACT = rf"fa AS (SELECT *, {_facts()} AS fact FROM (SELECT *, regexp_replace(lower(q), '\s+', '', 'g') AS aq FROM cs))"


@query("GAT10_facts", f"WITH {_CASES}, {_FACT} SELECT id, fact FROM fa")
def facts(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("id", answers.fact(F.col("q"), F.col("c"), F.col("e")).alias("fact"))


@query(
    "GAT09_direct_answers",
    f"""WITH {_CASES}, {_GATED}, k AS (SELECT *, split_part(id, '-', 1) AS query_id, split_part(id, '-', 2)::INT AS rank FROM gz), o AS (SELECT *, ok AND a <> '' AND NOT ({_ANY("substr(a, 1, 120)", fixed.REDIRECT_MARKERS)} AND NOT regexp_matches(substr(a, 1, 120), '{fixed.CONCRETE}')) AND NOT (rank % 4 = 1 AND rank * 0.03 < 0.2) AS stands FROM k)
    SELECT query_id, arg_min(a, rank) AS answer, min(rank) AS rank FROM o WHERE stands GROUP BY query_id""",
)
def direct_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a question stand in the order of their ids; every fourth has a rerank score."""
    rows = cases(spark, sf).withColumn("query_id", F.split_part("id", F.lit("-"), F.lit(1))).withColumn("rank", F.split_part("id", F.lit("-"), F.lit(2)).cast("int"))
    raw = F.when(F.col("rank") % 4 == 1, F.col("rank") * 0.03)
    return answers.direct(rows.withColumn("may", answers.may_stand(F.col("a"), text.is_redirect(F.col("a"), F.lit("")), raw) & answers.aligns(F.col("q"), F.col("a"))), "query_id", "rank", "a", "may").withColumnRenamed("a", "answer")


@query("GAT12_token_estimates", "SELECT doc_id, floor(length(text) * 1.5)::BIGINT AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", answers.tokens_estimate(F.col("text")).alias("tokens"))
