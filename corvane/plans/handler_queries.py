"""Questions answered from a graph by decision tables, over a graph of each nation and questions of each order."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import fixed, handler_rules, questions, rules
from corvane.operators import decisions, handlers
from corvane.plans.question_queries import _ENTITIES, _FOCUS, _LIT, _any, _case
from corvane.registry import query
from corvane.session import table
from corvane.shared import saved

# ---- the graph: for each nation (nk, with cc customers and the greatest key mx) nodes and their attributes, as expressions that both engines read

_GROUPS = ("2024_2025", "2023", "2022", "2021", "2017_2020", "2016_before")
_say = lambda x: f"CAST({x} AS STRING)"


def _attributes() -> list[tuple[str, str, str, str]]:
    """(node id without the unit, type, attribute, value)."""
    out = []
    for i, g in enumerate(_GROUPS):
        for j, t in enumerate(("내국인", "외국인", "편입생")):
            if (i + j) % 5 != 4:
                out += [(f"grad_{g}_{t}", "졸업요건", k, v) for k, v in (("졸업학점", _say(f"120 + (nk + {i}) % 20")), ("교양이수학점", _say("30 + nk % 7")), ("주전공이수학점", _say(f"{36 + i} + cc % 9")), ("적용학번그룹", f"'{g}'"))]
        out += [(f"grad_{g}_외국인", "졸업요건", "졸업인증", "concat('TOPIK ', " + _say(f"1 + (nk + {i}) % 6") + ", '급')")] if i % 2 == 0 else []
        for m in (1, 2, 3):
            out += [(f"method_{g}_방법{m}", "전공이수방법", k, v) for k, v in (("방법유형", f"'방법{m}'"), ("주전공학점", _say(f"{30 + 3 * m} + nk % 5")), ("제2전공학점", f"CASE WHEN (nk + {m}) % 4 = 0 THEN '' ELSE {_say(f'{40 - 3 * m} - nk % 3')} END"))]
    for g in ("2022이전", "2023이후"):
        new = g == "2023이후"
        out += [
            (f"reg_{g}", "수강신청규칙", k, v)
            for k, v in (
                ("재수강제한", "concat('학기당 ', " + _say("6 + mx % 4") + ", '학점')"),
                ("재수강기준성적", "CASE WHEN nk % 6 = 5 THEN '' ELSE 'C+이하' END"),
                ("재수강최고성적", "CASE WHEN nk % 4 = 3 THEN '' ELSE 'A' END"),
                ("수강신청사이트", "CASE WHEN nk % 5 = 4 THEN '' ELSE concat('https://sugang.example/', " + _say("nk") + ") END"),
                ("로그인오픈시간", "concat(" + _say("10 + nk % 30") + ", '분 전')"),
                ("평점4이상최대학점", _say("19 + nk % 6")),
                ("장바구니최대학점", _say("20 + cc % 9")),
                ("수강취소마감일시", "concat('2026-03-0', " + _say("1 + nk % 9") + ", CASE WHEN nk % 2 = 0 THEN ' 17:00' ELSE '' END)"),
                ("학점이월여부", "'폐지'" if new else "'최대 3학점'"),
                *([] if new else [("학점이월최대학점", _say("1 + nk % 3"))]),
            )
        ]
        out += [(f"early_grad_기준_{g}", "조기졸업", k, v) for k, v in (("구분", "'조기졸업 기준'"), ("기준학점", _say(f"{130 if new else 140} - nk % 5")))]
        out += [(f"ocu_{g}", "OCU", k, v) for k, v in (("납부시작", "concat('2026-02-1', " + _say("nk % 5") + ")"), ("납부종료", "concat('2026-02-1', " + _say("5 + nk % 5") + ")"), ("정규학기_최대학점", _say("6 + nk % 2")), ("정규학기_최대과목", _say("2 + nk % 2")), ("출석요건", "CASE WHEN nk % 3 = 2 THEN '' ELSE '3/4' END"))]
    out += [("season", "계절학기", k, v) for k, v in (("학기당최대학점", "CASE WHEN nk % 3 = 0 THEN '' ELSE concat(" + _say("6 + nk % 4") + ", '학점') END"), ("졸업까지최대학점", "CASE WHEN nk % 4 = 0 THEN '' ELSE '24학점' END"))]
    out += [("grading_성적선택제", "성적처리", k, v) for k, v in (("구분", "'성적선택제'"), ("신청", _say("mx")))]
    out += [("early_grad_신청자격", "조기졸업", "평점", _say("3 + nk % 2")), ("early_grad_기타사항", "조기졸업", "비고", "'취소 불가'")]
    out += [(f"scholarship_{n}", "장학금", k, v) for i, n in enumerate(handler_rules.SCHOLARSHIPS) if i != 3 for k, v in (("구분", f"'{n}'"), ("지급액", _say(f"(mx + {i}) * 1000")))]
    out += [(f"leave_{i}", "휴복학", k, v) for i, n in enumerate(("일반 휴학", "군입대 휴학", "창업휴학", "출산·육아 휴학", "복학", "재입학", "자퇴 (중도이탈)")) for k, v in (("구분", f"'{n}'"), ("서류", _say(f"nk + {i}")))]
    out += [(f"dept_{d}", "학과전공", k, v) for i, d in enumerate(("컴퓨터공학", "경영", "영어")) for k, v in (("구분", f"'{d}'"), ("졸업시험_요건", f"CASE WHEN (nk + {i}) % 2 = 0 THEN '' ELSE '합격' END"))]
    out += [("course_미적분학", "교과목", "학점", _say("1 + nk % 3")), ("teaching_영어", "교직", "설치학과", "'영어'")]
    return out


_UNIT = "concat('@', CAST(nk AS STRING))"
PHRASES = (
    "방법1 복수전공으로 졸업하려면", "졸업학점이 총 몇 학점", "졸업 요건", "유학생 TOPIK 졸업인증", "편입생 졸업학점은 얼마", "컴퓨터공학 졸업시험", "경영 졸업요건 면제", "휴학 중에 수강신청", "계절학기 최대 학점", "계절학기 신청", "재수강 제한 과목", "재수강 가능한 성적 기준",
    "성적선택 제도", "P/NP 신청", "학점이월 기준", "이월되는 학점", "수강신청 사이트 주소", "수강신청 사이트 로그인이 안 돼요", "로그인 시간 언제", "직전학기 평점 4.0", "장바구니 몇 개", "수강 취소 마감", "OCU 납부 기간", "ocu 초과 신청", "OCU 예외 학점", "OCU 정규학기 최대", "ocu 출석", "사이버 강의",
    "교직 이수 영어", "조기졸업", "국가장학금", "한국장학재단 근로장학금", "글로벌챌린저 장학", "군대 휴학", "출산 휴학", "자퇴 절차", "전과", "미적분학 과목 정보", "안내", "방법2",
)
INTENTS = ("GRADUATION_REQ", "REGISTRATION", "REGISTRATION", "MAJOR_CHANGE", "EARLY_GRADUATION", "SCHOLARSHIP", "LEAVE_OF_ABSENCE", "COURSE_INFO", "GRADUATION_REQ", "REGISTRATION", "REGISTRATION")
_P = "([" + ", ".join(map(_LIT, PHRASES)) + "])"


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (a rule to its unit's OCU node)."""
    customers = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_custkey").alias("m"))
    base = table(spark, sf, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_nationkey").cast("long").alias("nk"), F.coalesce("n", F.lit(0)).alias("cc"), F.coalesce("m", F.lit(0)).alias("mx"))
    unit = F.expr(_UNIT)
    rows = [F.struct(F.concat(F.lit(i), unit).alias("node_id"), F.lit(t).alias("node_type"), F.lit(k).alias("k"), F.expr(v).alias("v")) for i, t, k, v in _attributes()]
    parts = [base.select(unit.alias("unit"), F.inline(F.array(*rows[i : i + 24]))) for i in range(0, len(rows), 24)]  # expressions that still compile
    long = reduce(DataFrame.unionByName, parts)
    nodes = long.groupBy("node_id", "node_type", "unit").agg(F.collect_list(F.struct("k", "v")).alias("kv")).select("node_id", "node_type", F.map_from_entries(F.concat("kv", F.array(F.struct(F.lit("_unit").alias("k"), F.col("unit").alias("v"))))).alias("attrs"))
    edges = base.select(F.explode(F.array(*(F.struct(F.concat(F.lit(f"reg_{g}"), unit).alias("src"), F.concat(F.lit(f"ocu_{g}"), unit).alias("dst"), F.lit("has").alias("relation")) for g in ("2022이전", "2023이후")))).alias("e")).select("e.*")
    return saved(nodes), saved(edges)  # read once for each lookup


def asked(spark: SparkSession, sf: str) -> DataFrame:
    k, n, phrases, intents = F.col("o_orderkey"), len(PHRASES), F.array(*map(F.lit, PHRASES)), F.array(*map(F.lit, INTENTS))
    phrase = lambda i: F.get(phrases, i.cast("int"))
    text = F.concat(F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(2014 + F.col("o_custkey") % 12, F.lit("학번 "))), phrase(k % n), F.when(k % 5 > 1, F.lit("")).otherwise(F.concat(F.lit(" "), phrase(F.floor(k / n) % n))))
    rows = table(spark, sf, "orders").select(k.alias("query_id"), F.get(intents, (F.floor(k / 7) % len(INTENTS)).cast("int")).alias("intent"), F.concat(F.lit("@"), F.col("o_custkey") % 25).alias("unit"), text.alias("text"))
    t = F.col("text")
    return rows.withColumns({"student_id": questions.student_year(t), "student_type": questions.student_type(t), "entities": questions.entities(t)})


# ---- the twin: the same tables as SQL text


def _sql_value(ref: str) -> str:
    if "~" in ref:
        look, ends = ref.split(".", 1)
        start, end = (_sql_value(f"{look}.{x}") for x in ends.split("~"))
        return f"CASE WHEN {end} IS NULL OR {start} = {end} THEN {_sql_date(start)} ELSE {_sql_date(start)} || '부터 ' || substr({end}, 6, 2)::INT || '월 ' || substr({end}, 9, 2)::INT || '일까지' END"
    ref, _, form = ref.partition("|")
    if "." not in ref:
        return f"q.{ref}"
    look, name = ref.split(".", 1)
    if name == "node_id":
        return f"l_{look}.node_id"
    value = f"nullif(l_{look}.attrs[{_LIT(name)}], '')"
    return {"": value, "ended": f"CASE WHEN contains({value}, '불가') OR contains({value}, '폐지') THEN '폐지' END", "date": _sql_date(f"split_part({value}, ' ', 1)"), "hour": f"nullif(substr(split_part({value}, ' ', 2), 1, 2), '')"}[form]


def _sql_date(day: str) -> str:
    return f"(substr({day}, 1, 4)::INT || '년 ' || substr({day}, 6, 2)::INT || '월 ' || substr({day}, 9, 2)::INT || '일')"


def _sql_part(template: str) -> str:
    return "(" + " || ".join(_sql_value(p) if i % 2 else _LIT(p) for i, p in enumerate(decisions.REF.split(template)) if i % 2 or p) + ")"


def _sql_parts(templates: tuple[str, ...], between: str) -> str:
    return f"array_to_string(list_filter([{', '.join(map(_sql_part, templates))}], lambda x: x IS NOT NULL), '{between}')" if templates else "''"


def _sql_rule(rule: decisions.Rule) -> tuple[str, str]:
    holds = [_any(g, "q.text") for g in rule.text] + [_any(g, "q.norm") for g in rule.norm] + ([f"NOT {_any(rule.not_text, 'q.text')}"] if rule.not_text else []) + ([f"NOT {_any(rule.not_norm, 'q.norm')}"] if rule.not_norm else [])
    holds += [f"q.e_{e} IS NOT NULL" for e in rule.named] + [f"q.e_{e} IS NULL" for e in rule.unnamed] + [f"q.{f}" for f in rule.flags] + [f"NOT q.{f}" for f in rule.unflagged] + [f"{_sql_value(r)} IS NOT NULL" for r in rule.needs]
    own = decisions._own(rule)
    holds += [f"l_{own}.node_id IS NOT NULL"] if own else []
    node = f"l_{own}.node_id" if own else _sql_part(rule.node) if rule.node else "NULL"
    return " AND ".join(holds) or "true", f"{{'name': {_LIT(rule.name)}, 'score': {rule.score}::DOUBLE, 'answer': {_sql_parts(rule.answer, ' ')}, 'context': {_sql_parts(rule.context, '')}, 'node_id': ({node})::VARCHAR, 'plain': {'false' if rule.node else 'true'}}}"


def _sql_handler(handler: decisions.Handler) -> str:
    rest = "list_filter([" + ", ".join(f"CASE WHEN {g} THEN {t} END" for g, t in map(_sql_rule, handler.rest)) + "], lambda x: x IS NOT NULL)"
    return _case([(g, f"[{t}]") for g, t in map(_sql_rule, handler.first)], rest) if handler.first else rest


_ENT = ("major_method", "department", "course_name", "graduation_cert", "ocu", "gpa_exception", "basket_limit", "registration_deadline", "payment_period")
_YEAR = r"coalesce(nullif(regexp_extract(text, '(20[12][0-9])학번', 1), ''), '20' || nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z_가-힣])([12][0-9])학번', 1), ''))"
_GROUP = f"CASE WHEN student_id IS NULL THEN '' WHEN student_id >= '2024' THEN '2024_2025' WHEN student_id >= '2021' THEN student_id WHEN student_id >= '2017' THEN '2017_2020' ELSE '2016_before' END"
_STATIC = "array_to_string(list_concat([coalesce(n.attrs['구분'], n.node_type) || ' 안내'], list_transform(list_sort(list_filter(map_entries(n.attrs), lambda e: coalesce(e.value, '') <> '' AND e.key <> '구분' AND NOT starts_with(e.key, '_'))), lambda e: '- ' || e.key || ': ' || e.value)), chr(10))"


@cache
def _twin() -> str:
    rows = ", ".join(f"{{'node_id': {_LIT(i)} || {_UNIT}, 'node_type': {_LIT(t)}, 'k': {_LIT(k)}, 'v': {v}}}" for i, t, k, v in _attributes())
    looks = handler_rules.LOOKUPS
    joins = " ".join(
        f"LEFT JOIN (SELECT e.src, min(e.dst) AS dst FROM ed e JOIN nd ON nd.node_id = e.dst AND node_type = {_LIT(look.node_type)} GROUP BY e.src) h_{name} ON h_{name}.src = l_{look.of}.node_id LEFT JOIN nd l_{name} ON l_{name}.node_id = h_{name}.dst" if look.of else f"LEFT JOIN nd l_{name} ON l_{name}.node_id = {_sql_part(look.key)}"
        for name, look in looks.items()
    )
    told = _case([(" AND ".join([f"q.intent = {_LIT(h.intent)}", *(f"{_sql_value(g)} IS NOT NULL" for g in h.gate)]), _sql_handler(h)) for h in handler_rules.HANDLERS], "[]")
    kinds = lambda column, own: "list_filter([" + ", ".join(f"CASE WHEN {_any((*([kind] if own else []), *words), column)} THEN {_LIT(kind)} END" for kind, words in handler_rules.LEAVE_KINDS.items()) + "], lambda x: x IS NOT NULL)"
    norm = lambda c: rf"lower(regexp_replace({c}, '[\s\-.,:()\[\]/~·]', '', 'g'))"
    return f"""WITH ba AS (SELECT n_nationkey::BIGINT AS nk, coalesce(n, 0) AS cc, coalesce(m, 0) AS mx FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, max(c_custkey) AS m FROM customer GROUP BY 1) ON c_nationkey = n_nationkey),
    lo AS (SELECT {_UNIT} AS unit, unnest([{rows}]) AS r FROM ba), nd AS (SELECT r.node_id AS node_id, r.node_type AS node_type, unit, map_from_entries(list((r.k, r.v))) AS attrs FROM lo GROUP BY 1, 2, 3),
    ed AS (SELECT 'reg_' || g || {_UNIT} AS src, 'ocu_' || g || {_UNIT} AS dst FROM ba, (VALUES ('2022이전'), ('2023이후')) t(g)),
    q0 AS (SELECT o_orderkey AS query_id, {"([" + ", ".join(map(_LIT, INTENTS)) + "])"}[(o_orderkey // 7) % {len(INTENTS)} + 1] AS intent, '@' || (o_custkey % 25) AS unit,
      concat(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE (2014 + o_custkey % 12) || '학번 ' END, {_P}[o_orderkey % {len(PHRASES)} + 1], CASE WHEN o_orderkey % 5 > 1 THEN '' ELSE ' ' || {_P}[(o_orderkey // {len(PHRASES)}) % {len(PHRASES)} + 1] END) AS text FROM orders),
    q1 AS (SELECT *, {_YEAR} AS student_id, {_case([(_any(ws), _LIT(n)) for n, ws in rules.STUDENT_TYPES], _LIT("내국인"))} AS student_type, {norm("text")} AS norm, {", ".join(f"{_ENTITIES[e]} AS e_{e}" for e in _ENT)}, (CASE WHEN {_YEAR} IS NOT NULL THEN 'x' END) AS e_student_groups FROM q0),
    q2 AS (SELECT *, {_GROUP} AS "group", CASE WHEN coalesce(student_id, '2023') >= '2023' THEN '2023이후' ELSE '2022이전' END AS reg_group, CASE WHEN student_id::INT <= 2022 THEN '2022이전' ELSE '2023이후' END AS early_group, student_id IS NOT NULL AS has_year,
      student_type = '내국인' AS is_domestic, student_type = '외국인' AS is_foreign, student_type = '편입생' AS is_transfer, {_any(fixed.TROUBLE_SIGNS, "lower(text)")} AS trouble, e_ocu IS NOT NULL OR contains(norm, 'ocu') OR contains(norm, '사이버') AS asks_ocu,
      contains(text, '학점이월') OR (contains(text, '이월') AND contains(text, '학점')) AS asks_carry, e_major_method AS major_method, e_department AS department, e_course_name AS course_name FROM q1),
    q AS (SELECT * REPLACE (NULL AS e_student_groups), {_case([(f'"group" = {_LIT(k)}', _LIT(v)) for k, v in handler_rules.GROUP_LABELS.items()], "'학번'")} AS label, CASE WHEN reg_group = '2023이후' THEN '2023학번 이후' ELSE '2022학번 이전' END AS reg_label FROM q2),
    fo AS (SELECT q.query_id, q.intent, q.unit, q.norm, {told} AS told FROM q {joins}),
    ro AS (SELECT query_id, generate_subscripts(told, 1) - 1 AS pos, unnest(told) AS t FROM fo),
    rt AS (SELECT query_id, pos, t.name AS name, t.score AS score, t.answer AS answer, CASE WHEN n.node_id IS NOT NULL AND t.context = '' THEN {_STATIC} ELSE t.context END AS context, t.node_id AS node_id FROM ro LEFT JOIN nd n ON n.node_id = t.node_id WHERE t.node_id IS NULL OR n.node_id IS NOT NULL),
    ev AS (SELECT query_id, 0 AS pos, 'every' AS name, 1.0 AS score, '' AS answer, {_STATIC} AS context, n.node_id FROM fo JOIN nd n USING (unit) WHERE intent = 'SCHOLARSHIP' AND n.node_type = '장학금' AND query_id NOT IN (SELECT query_id FROM rt)),
    ln AS (SELECT *, {kinds(norm("attrs['구분']"), True)} AS ks, row_number() OVER (PARTITION BY unit ORDER BY node_id) AS place FROM nd WHERE node_type = '휴복학'), lq AS (SELECT *, {kinds("norm", False)} AS ks FROM fo WHERE intent = 'LEAVE_OF_ABSENCE'),
    lk AS (SELECT query_id, 0 AS pos, 'kind' AS name, 1.2 AS score, '' AS answer, {_STATIC} AS context, n.node_id FROM lq JOIN ln n ON n.unit = lq.unit AND list_has_any(lq.ks, n.ks)),
    la AS (SELECT query_id, 0 AS pos, 'any' AS name, 1.0 AS score, '' AS answer, {_STATIC} AS context, n.node_id FROM lq JOIN ln n ON n.unit = lq.unit AND place <= 2 WHERE query_id NOT IN (SELECT query_id FROM lk))
    SELECT a.*, intent FROM (SELECT * FROM rt UNION ALL SELECT * FROM ev UNION ALL SELECT * FROM lk UNION ALL SELECT * FROM la) a JOIN q0 USING (query_id)"""


def _answered(spark: SparkSession, sf: str, intent: str) -> DataFrame:
    nodes, edges = graph(spark, sf)
    return handlers.answers(asked(spark, sf).where(F.col("intent") == intent), nodes, edges)


def _register() -> None:
    """A query for each handler."""
    for name, intent in (("GRA10a_graduation", "GRADUATION_REQ"), ("GRA10b_registration", "REGISTRATION"), ("GRA10d_course_info", "COURSE_INFO"), ("GRA10e_major_change", "MAJOR_CHANGE"), ("GRA10f_early_graduation", "EARLY_GRADUATION"), ("GRA10g_scholarship", "SCHOLARSHIP"), ("GRA10h_leave", "LEAVE_OF_ABSENCE")):
        twin = _twin()
        query(name, f"SELECT * EXCLUDE (intent) FROM ({twin}) WHERE intent = {_LIT(intent)}")(lambda spark, sf, intent=intent: _answered(spark, sf, intent))
    query("GRA09_dispatch", f"SELECT intent, name, count(*) AS n, round(sum(score), 3) AS score, count(*) FILTER (answer <> '') AS direct FROM ({twin}) GROUP BY intent, name")(dispatched)


def dispatched(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule speaks, over all intents in one plan."""
    nodes, edges = graph(spark, sf)
    questions_ = asked(spark, sf)
    found = handlers.answers(questions_, nodes, edges).join(questions_.select("query_id", "intent"), "query_id")
    return found.groupBy("intent", "name").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"), F.count_if(F.col("answer") != "").alias("direct"))


_register()
