"""Dictionaries of terms and the analysis of questions that builds on them, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import english, english_rules, fixed, questions, rules
from corvane.functions.text import student_group
from corvane.operators import terms
from corvane.plans.question_queries import _FOCUS, _INTENT, _LIT, _SCORES, _TYPE, _Q, _any, _case, _fits, asked
from corvane.registry import query
from corvane.session import table

_WORDS = lambda xs: "([" + ", ".join(map(_LIT, xs)) + "]::VARCHAR[])"


def _escaped(term: str) -> str:
    return "".join("\\" + c if c in "()+/.*?[]|^$" else c for c in term)


# ---- replacement by the glossary

_GLOSSARY_KEYS = sorted(fixed.GLOSSARY, key=len, reverse=True)
_PATTERN = _LIT("|".join(map(_escaped, _GLOSSARY_KEYS)))
_NORMALIZED = f"""array_to_string(list_transform(range(1, len(string_split_regex(text, {_PATTERN})) + 1), lambda i: string_split_regex(text, {_PATTERN})[i]
  || coalesce({_WORDS([fixed.GLOSSARY[k] for k in _GLOSSARY_KEYS])}[list_position({_WORDS(_GLOSSARY_KEYS)}, regexp_extract_all(text, {_PATTERN})[i])], '')), '')"""


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.GLOSSARY.items()), "term string, value string")


@query("SCA09_glossary", f"WITH {_Q} SELECT qid, {_NORMALIZED} AS normalized FROM qu")
def formal_terms(spark: SparkSession, sf: str) -> DataFrame:
    found = terms.replaced_terms(asked(spark, sf).select("qid", "text"), "text", glossary(spark))
    return found.select("qid", F.col("text").alias("normalized"))


_NAME_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part"


def _name_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct().withColumn("value", F.concat(F.lit("<"), "term", F.lit(">")))


@query("SCA09_marked_documents", f"SELECT doc_id, md5(regexp_replace(text, (SELECT '(' || string_agg(w, '|' ORDER BY length(w) DESC, w) || ')' FROM ({_NAME_WORDS})), '<\\1>', 'g')) AS marked FROM documents")
def marked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each word of the parts' names put in brackets wherever a document has it."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return terms.replaced_terms(docs, "text", _name_words(spark, sf)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("marked"))


_OPENINGS = "SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+')) AS w FROM benchmark WHERE regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+') UNION SELECT unnest(string_split(p_name, ' ')) FROM part"


def _openings(spark: SparkSession, sf: str) -> DataFrame:
    two = F.lower(F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0))
    items = table(spark, sf, "benchmark").where(F.col("text").rlike("^[A-Za-z]+ [A-Za-z]+")).select(two.alias("term"))
    return items.unionByName(_name_words(spark, sf).select("term")).distinct().withColumn("value", F.col("term"))


@query(
    "SCA10_terms_of_documents",
    f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, (SELECT '(?i)\\b(?:' || string_agg(w, '|' ORDER BY length(w) DESC, w) || ')\\b' FROM ({_OPENINGS}))), lambda x: lower(x)), ',') AS terms FROM documents WHERE text IS NOT NULL",
)
def terms_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole words of a document, whatever their case, that are a part's word or begin a benchmark item."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    found = terms.found_terms(docs, "text", _openings(spark, sf), whole_words=True, ignore_case=True)
    return found.select("doc_id", F.array_join(F.transform("found", lambda f: f["value"]), ",").alias("terms"))


@query("JOI06_words_within", f"SELECT doc_id, w AS word FROM documents JOIN ({_NAME_WORDS}) ON contains(text, w)")
def words_within(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the words of parts' names that they contain, by the index of n-grams."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    pairs = terms.substring_pairs(docs, _name_words(spark, sf).select(F.col("term").alias("needle")))
    return pairs.select(F.col("id").alias("doc_id"), F.col("needle").alias("word"))


# ---- the whole analysis of questions

_GROUP = lambda y: f"CASE WHEN {y} >= '2024' THEN '2024_2025' WHEN {y} >= '2021' THEN {y} WHEN {y} >= '2017' THEN '2017_2020' ELSE '2016_before' END"
_YEAR = r"coalesce(nullif(regexp_extract(text, '(20[12][0-9])학번', 1), ''), '20' || nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z_가-힣])([12][0-9])학번', 1), ''), nullif(regexp_extract(text, '(20[12][0-9])\s*[~\-]\s*(20[12][0-9])학번', 1), ''))"
_IN = lambda xs: "(" + ", ".join(map(_LIT, xs)) + ")"
_KOREAN = f"""SELECT qid, intent, {_YEAR} AS student_id, {_case([(_any(ws), _LIT(n)) for n, ws in rules.STUDENT_TYPES], _LIT("내국인"))} AS student_type,
  {_case([(_any(rules.BOTH_WORDS), "true"), (_any(rules.TEXT_ONLY_WORDS), "false")], f"intent IN {_IN(rules.GRAPH_INTENTS)}")} AS requires_graph,
  {_any(rules.BOTH_WORDS)} OR {_any(rules.TEXT_ONLY_WORDS)} OR (contains(lower(text), 'ocu') AND {_any(rules.OCU_TEXT_WORDS)}) OR intent <> 'SCHEDULE' OR {_any(rules.SCHEDULE_TEXT_WORDS)} AS requires_vector,
  CASE WHEN {_YEAR} IS NULL AND intent IN {_IN(rules.YEAR_INTENTS)} THEN 'student_id' ELSE '' END AS missing_info, 'ko' AS lang, {_TYPE} AS question_type, NULL::VARCHAR AS ko_query
  FROM (SELECT *, {_INTENT} AS intent, {_FOCUS} AS fo FROM (SELECT *, {_SCORES} AS sc FROM (SELECT qid, {_NORMALIZED} AS text FROM qu)))"""
_FLAT = ("intent", "student_id", "student_type", "requires_graph", "requires_vector", "lang", "question_type", "ko_query")


def _flat(found: DataFrame) -> DataFrame:
    return found.select("qid", *_FLAT, F.array_join("missing_info", ",").alias("missing_info"))


@query("QUE07_analysis", f"WITH {_Q} {_KOREAN}")
def korean_analysis(spark: SparkSession, sf: str) -> DataFrame:
    formal = terms.replaced_terms(asked(spark, sf).select("qid", "text"), "text", glossary(spark))
    return _flat(questions.analyzed(formal, "text", student_group))


#: A few entries of a table of English terms, which is a parameter of the analysis.
ENGLISH_TERMS = (
    ("course registration", "수강신청"), ("registration", "수강신청"), ("graduation requirements", "졸업요건"), ("graduation", "졸업"), ("early graduation", "조기졸업"), ("double major", "복수전공"), ("minor", "부전공"), ("scholarship", "장학금"),
    ("leave of absence", "휴학"), ("grade point average", "평점"), ("gpa", "평점"), ("credits", "학점"), ("alternative course", "대체과목"), ("tuition", "등록금"), ("tuition refund", "등록금 반환"), ("timetable", "시간표"), ("computer engineering", "컴퓨터공학과"),
    ("retake", "재수강"), ("seasonal semester", "계절학기"), ("change of major", "전과"), ("final exam", "기말고사"), ("ocu", "OCU"),
)
PHRASES = (
    "When is the application period for early graduation", "How many credits are required for a double major credit plan", "What are the graduation requirements for the class of 2020", "Where can I apply for a scholarship as an international student",
    "Is it possible to retake an alternative course", "pass/fail conversion deadline", "2021 cohort table of credits required per minor", "transfer student admitted in 2022 registration", "admitted in 2019 or later leave of absence", "22 cohort GPA 4.0 basket limit",
    "when does the wish list open", "Drop deadline for OCU, second semester", "TOPIK score for option 2 of a major", "method 1 ABC1234", "computer engineering timetable", "what changed in tuition refund", "volunteer and college english", "How do I pay tuition payment", "nothing in particular", "Which office handles change of major",
)
_PHRASES = _WORDS(PHRASES)
_EN_KEYS = sorted((t for t, _ in ENGLISH_TERMS), key=len, reverse=True)
_EN_VALUES = dict(ENGLISH_TERMS)
_EN_FOUND = f"list_transform(regexp_extract_all(text, '(?i)\\b(?:{'|'.join(_EN_KEYS)})\\b'), lambda x: {_WORDS([_EN_VALUES[k] for k in _EN_KEYS])}[list_position({_WORDS(_EN_KEYS)}, lower(x))])"
_EQ = f"""eq AS (SELECT 'o' || o_orderkey AS qid, {_PHRASES}[o_orderkey % {len(PHRASES)} + 1] || CASE WHEN o_orderkey % 3 = 0 THEN '?' ELSE ' ' || {_PHRASES}[(o_orderkey // {len(PHRASES)}) % {len(PHRASES)} + 1] END AS text FROM orders
UNION ALL SELECT 'd' || doc_id, text FROM documents WHERE lang = 'en' AND text IS NOT NULL)"""
_low = lambda words: _any(words, "low")
_en_fits = lambda groups, none=(): " AND ".join([*map(_low, groups), *([f"NOT {_low(none)}"] if none else [])])
_EN_FOCUS = f"CASE WHEN f0 = 'period' AND {_low(english_rules.NO_PERIOD)} THEN NULL ELSE f0 END"
_ONCE = lambda xs: f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"  # noqa: E731  list_distinct doesn't keep the order
_SAME = f"({_low(english_rules.EQUIVALENTS)} AND contains(low, 'retake'))"
_GRADING = f"({_low(english_rules.GRADE_CHOICE)} AND NOT {_SAME})"
_EN_YEAR = r"""coalesce(nullif(regexp_extract(text, '(?i)\bclass\s+of\s+(20[12]\d)\b|\b(20[12]\d)\s+(?:student|cohort|enrollment|year)\b', 1), ''), nullif(regexp_extract(text, '(?i)\bclass\s+of\s+(20[12]\d)\b|\b(20[12]\d)\s+(?:student|cohort|enrollment|year)\b', 2), ''),
  regexp_extract(list_filter(regexp_extract_all(text, '(?i)\badmitted\s+in\s+20[12]\d\b(?:\s+(?:or|and)\s+later)?'), lambda x: NOT ends_with(lower(x), 'later'))[1], '20[12]\d'), '20' || nullif(regexp_extract(text, '(?i)\b([12]\d)\s+(?:cohort|enrollment|admission year|class)\b', 1), ''))"""
_EN_TYPE = _TYPE.replace("text", "coalesce(ko_query, question)").replace("fo = ", "NULL::VARCHAR = ")
_ENGLISH = f"""{_EQ}, e1 AS (SELECT qid, text, lower(text) AS low, {_EN_FOUND} AS ts FROM eq), e2 AS (SELECT *, {_case([(_en_fits(g), _LIT(n)) for n, g in english_rules.FOCUS_RULES])} AS f0 FROM e1), e3 AS (SELECT *, {_EN_FOCUS} AS fo2 FROM e2),
  e4 AS (SELECT *, {_case([(f"regexp_matches(text, '{p}')", _LIT(n)) for n, p in english_rules.STUDENT_TYPES], _LIT("내국인"))} AS student_type FROM e3),
  e5 AS (SELECT *, list_concat(ts, {", ".join(f"CASE WHEN fo2 = {_LIT(k)} THEN {_WORDS((v,))} ELSE [] END" for k, v in english_rules.FOCUS_TERMS.items())}, {", ".join(f"CASE WHEN {_low(w)} THEN {_WORDS((v,))} ELSE [] END" for w, v in english_rules.PHRASE_TERMS)},
    CASE WHEN student_type = {_LIT(english_rules.TRANSFER)} THEN {_WORDS(english_rules.TRANSFER_TERMS)} ELSE [] END) AS all_terms FROM e4),
  e6 AS (SELECT * EXCLUDE (text), text AS question, nullif(array_to_string({_ONCE("all_terms")}, ' '), '') AS ko_query FROM e5), e7 AS (SELECT *, {_SCORES.replace("contains(text", "contains(ko_query")} AS sc FROM e6),
  e8 AS (SELECT *, CASE WHEN ko_query IS NULL THEN 'GENERAL' ELSE {_INTENT.replace("contains(text", "contains(ko_query")} END AS i0 FROM e7),
  e9 AS (SELECT *, question AS text, CASE WHEN {_SAME} THEN 'ALTERNATIVE' WHEN {_GRADING} THEN 'REGISTRATION' ELSE i0 END AS intent FROM e8)"""


@query(
    "QUE06_english_analysis",
    f"""WITH {_ENGLISH} SELECT qid, intent, {_EN_YEAR} AS student_id, student_type, CASE WHEN {_GRADING} THEN coalesce(fo2 = 'period', false) ELSE i0 IN {_IN(rules.GRAPH_INTENTS)} END AS requires_graph, true AS requires_vector,
    CASE WHEN {_EN_YEAR} IS NULL AND intent IN {_IN(rules.YEAR_INTENTS)} THEN 'student_id' ELSE '' END AS missing_info, 'en' AS lang, {_EN_TYPE} AS question_type, ko_query FROM e9""",
)
def english_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(english.analyzed(_with_terms(spark, sf), "text", "terms"))


def _with_terms(spark: SparkSession, sf: str) -> DataFrame:
    found = terms.found_terms(english_questions(spark, sf), "text", spark.createDataFrame(ENGLISH_TERMS, "term string, value string"), whole_words=True, ignore_case=True)
    return found.select("qid", "text", F.transform("found", lambda f: f["value"]).alias("terms"))


_EN_ENTITIES = {
    "graduation_cert": _case([(_low((w,)), _LIT(w.upper() if w in english_rules.UPPER_CERTIFICATES else w)) for w in english_rules.CERTIFICATES]),
    "major_method": "coalesce(" + _case([(_low((w,)), _LIT(v)) for w, v in english_rules.MAJOR_METHODS]) + f", CASE WHEN {_low(english_rules.MAJOR_CONTEXT)} THEN " + _case([(_low((w,)), _LIT(v)) for w, v in english_rules.MAJOR_OPTIONS]) + " END)",
    "department": f"list_filter(ts, lambda t: {_any(rules.DEPARTMENTS, 't')})[1]",
    "course_number": "nullif(regexp_extract(text, '[A-Z]{2,4}[0-9]{3,4}'), '')",
    "semester_half": _case([(_low(ws), _LIT(n)) for n, ws in english_rules.HALVES]),
    "liberal_arts_area": _case([(_low(ws), _LIT(n)) for n, ws in english_rules.LIBERAL_ARTS]),
    "question_focus": "fo2",
} | {name: f"CASE WHEN {_en_fits(*rule)} THEN 'true' END" for name, rule in english_rules.ENTITY_FLAGS.items()}


@query("QUE06_english_entities", f"WITH {_ENGLISH} SELECT qid, k, v FROM (SELECT qid, unnest([{', '.join(map(_LIT, _EN_ENTITIES))}]) AS k, unnest([{', '.join(_EN_ENTITIES.values())}]) AS v FROM e9) WHERE v IS NOT NULL")
def english_entities(spark: SparkSession, sf: str) -> DataFrame:
    return english.analyzed(_with_terms(spark, sf), "text", "terms").select("qid", F.explode("entities").alias("k", "v"))


def english_questions(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, text): a question of one or two phrases for each order, and every English document."""
    k, n, phrases = F.col("o_orderkey"), len(PHRASES), F.array(*map(F.lit, PHRASES))
    phrase = lambda i: F.get(phrases, i.cast("int"))
    more = F.when(k % 3 == 0, F.lit("?")).otherwise(F.concat(F.lit(" "), phrase(F.floor(k / n) % n)))
    ordered = table(spark, sf, "orders").select(F.concat(F.lit("o"), k).alias("qid"), F.concat(phrase(k % n), more).alias("text"))
    return ordered.unionByName(table(spark, sf, "documents").where("lang = 'en' AND text IS NOT NULL").select(F.concat(F.lit("d"), "doc_id").alias("qid"), "text"))
