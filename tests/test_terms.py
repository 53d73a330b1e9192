"""Dictionaries against a plain scan, both ways of search; and analyses against expectations written out by hand."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import english, fixed, questions, rules, text
from corvane.functions.text import student_group
from corvane.operators import terms
from corvane.plans.term_queries import ENGLISH_TERMS, glossary


def plain(entries, body, whole, fold):
    low = body.lower() if fold else body
    keys = sorted({t.lower() if fold else t for t, _ in entries if t}, key=len, reverse=True)
    out, i = [], 0
    while i < len(body):
        for k in keys:
            end = i + len(k)
            free = not (i and re.match("[A-Za-z0-9_]", body[i - 1]) or end < len(body) and re.match("[A-Za-z0-9_]", body[end]))
            if low.startswith(k, i) and (free or not whole):
                out.append((i, end, k))
                i = end - 1
                break
        i += 1
    return out


def test_random_dictionaries():
    rng = random.Random(1)
    for _ in range(10_000):
        letters = rng.choice(["ab", "ab ", "aB가 _"])
        entries = [("".join(rng.choice(letters) for _ in range(rng.randrange(6))), str(rng.randrange(9))) for _ in range(rng.randrange(12))]
        body = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        whole, fold = rng.random() < 0.5, rng.random() < 0.5
        assert [f[:3] for f in terms.Dictionary(entries, whole, fold).find(body)] == plain(entries, body, whole, fold)


@pytest.mark.parametrize(("whole", "fold"), [(False, False), (True, True)])
def test_automaton_and_join_agree(spark, monkeypatch, whole, fold):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("ab cD가") for _ in range(rng.choice([5, 60, 1500])))) for i in range(120)] + [(500, None), (501, "")]
    entries = list({"".join(rng.choice("ab cd가") for _ in range(rng.randrange(1, 7))): str(i) for i in range(60)}.items())
    rows, table = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(entries, "term string, value string")
    read = lambda: {r["k"]: [tuple(x) for x in r["found"]] for r in terms.found_terms(rows, "t", table, whole_words=whole, ignore_case=fold).collect()}
    by_automaton = read()
    replaced = {r["k"]: r["t"] for r in terms.replaced_terms(rows, "t", table, whole, fold).collect()}
    assert replaced == {k: terms.Dictionary(entries, whole, fold).replace(t) for k, t in texts}
    monkeypatch.setattr(terms, "DICTIONARY_CHARS", 0)
    monkeypatch.setattr(terms, "PIECE_CHARS", 16)
    assert read() == by_automaton and sum(map(len, by_automaton.values())) > 1000


def test_substring_pairs(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(900)))) for i in range(40)]
    needles = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12)] + ["zz", ""]
    pairs = terms.substring_pairs(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert {tuple(r) for r in pairs.collect()} == {(i, n) for i, t in texts for n in needles if n and n in t}
    assert "BroadcastNestedLoopJoin" not in pairs._jdf.queryExecution().toString()
    assert terms.substring_pairs(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "needle string")).count() == 0


def test_glossary_by_hand(spark):
    given = {"전필 몇학점?": ("전공필수", "몇 학점"), "복전 하고 싶어": ("복수전공",), "부전 학점": ("부전공",), "평범한 문장이다": ("평범한 문장이다",), "": ("",)}
    found = {r["k"]: r["t"] for r in terms.replaced_terms(spark.createDataFrame([(q, q) for q in given], "k string, t string"), "t", glossary(spark)).collect()}
    assert all(w in found[q] for q, words in given.items() for w in words)
    assert found["평범한 문장이다"] == "평범한 문장이다"


#: question: intent, year of entry, entities among those found, graph, vector, missing
KOREAN = {
    "2023학번 졸업요건이 궁금합니다": ("GRADUATION_REQ", "2023", {}, True, True, []),
    "졸업요건이 궁금합니다": ("GRADUATION_REQ", None, {}, True, True, ["student_id"]),
    "수강신청 기간 알려줘": ("SCHEDULE", None, {"question_focus": "period"}, True, False, []),
    "중간고사는 언제 치나요": ("SCHEDULE", None, {"question_focus": "period"}, True, False, []),
    "복수전공 하고 싶어요": ("MAJOR_CHANGE", None, {}, True, True, ["student_id"]),
    "미적분학 대체과목이 뭔가요": ("ALTERNATIVE", None, {"course_name": "미적분학"}, True, True, []),
    "안녕": ("GENERAL", None, {}, True, True, []),
    "컴퓨터공학 강의": ("COURSE_INFO", None, {"department": "컴퓨터공학"}, True, True, []),
    "2023학번 직전학기 평점 4.0이면 몇 학점 되나요": ("REGISTRATION", "2023", {"gpa_exception": "true"}, True, True, []),
    "장바구니에 최대 몇 개": ("REGISTRATION", None, {"basket_limit": "true"}, True, True, ["student_id"]),
    "성적선택 제도 설명": ("REGISTRATION", None, {}, False, True, ["student_id"]),
    "P/NP 는 무엇": ("REGISTRATION", None, {}, False, True, ["student_id"]),
    "성적처리 기준": ("GRADUATION_REQ", None, {}, True, True, ["student_id"]),
    "중간고사 성적 일정": ("SCHEDULE", None, {}, True, True, []),
    "2016학번과 2020학번 2024학번 비교 졸업": ("GRADUATION_REQ", "2016", {"student_groups": "2016_before,2017_2020,2024_2025"}, True, True, []),
}


def test_korean_questions_by_hand(spark):
    formal = terms.replaced_terms(spark.createDataFrame([(q, q) for q in KOREAN], "q string, text string"), "text", glossary(spark))
    for r in questions.analyzed(formal, "text", student_group).collect():
        intent, year, named, graph, vector, missing = KOREAN[r["q"]]
        assert (r["intent"], r["student_id"], r["requires_graph"], r["requires_vector"], r["missing_info"]) == (intent, year, graph, vector, missing), r
        assert named.items() <= r["entities"].items(), r


#: question: what must be found (None: must not be)
ENGLISH = {
    "What are the graduation requirements?": {"intent": "GRADUATION_REQ", "requires_graph": True, "question_focus": "rule_list", "lang": "en"},
    "When does course registration begin?": {"intent": "SCHEDULE", "question_focus": "period"},
    "How many credits can I take?": {"question_focus": "limit"},
    "I am an exchange student.": {"student_type": "외국인"},
    "A transfer student asks": {"student_type": "편입생", "ko_query": "편입학생 교육과정 이수방법"},
    "I belong to the class of 2020": {"student_id": "2020"},
    "2021 cohort, please": {"student_id": "2021"},
    "students admitted in 2022": {"student_id": "2022"},
    "students admitted in 2022 or later": {"student_id": None},
    "the 2020 calendar": {"student_id": None},
    "22 cohort": {"student_id": "2022"},
    "an OCU lecture": {"ocu": "true"},
    "with a GPA 4.0": {"gpa_exception": "true"},
    "how full may the basket be": {"basket_limit": "true"},
    "when does the basket open": {"basket_limit": None},
    "tuition payment at the bank": {"payment_period": "true"},
    "double major credit": {"second_major_credits": "true"},
    "TOPIK 4": {"graduation_cert": "TOPIK"},
    "method 1 please": {"major_method": "방법1"},
    "option 2 for my major": {"major_method": "방법2"},
    "option 2 for lunch": {"major_method": None},
    "credits transferred abroad": {"question_focus": None},
    "how to pay": {"question_focus": "method"},
    "which building is it": {"question_focus": "location"},
    "am I eligible": {"question_focus": "eligibility"},
    "which website has it": {"asks_url": "true"},
    "fall semester": {"semester_half": "후기"},
    "the spring semester": {"semester_half": "전기"},
    "pass/fail conversion": {"intent": "REGISTRATION", "requires_graph": False, "requires_vector": True},
    "retake an equivalent course": {"intent": "ALTERNATIVE"},
    "hello there": {"intent": "GENERAL", "ko_query": None},
}


def test_english_questions_by_hand(spark):
    rows = terms.found_terms(spark.createDataFrame([(q,) for q in ENGLISH], "text string"), "text", spark.createDataFrame(ENGLISH_TERMS, "term string, value string"), whole_words=True, ignore_case=True)
    rows = rows.select("text", F.transform("found", lambda f: f["value"]).alias("terms"))
    for r in english.analyzed(rows, "text", "terms").collect():
        found = r.asDict() | r["entities"]
        assert {k: found.get(k) for k in ENGLISH[r["text"]]} == ENGLISH[r["text"]], r


REDIRECTS = {
    ("시간표의 졸업기준을 참고하시기 바랍니다. 통합정보시스템 > 졸업", None): True,
    ("학사안내를 참고하시기바랍니다", None): True,
    ("공지를 참고 바랍니다", None): True,
    ("학과로 문의하시기 바랍니다", None): True,
    ("졸업학점은 130학점 이상입니다. 자세한 사항은 안내를 참고하시기 바랍니다.", None): False,
    ("후기 졸업식 : 2026.08.21.(금) 예정. 자세한 사항은 각 학부(과) 사무실에 문의하시기 바랍니다.", None): False,
    ("130학점 이상입니다.", None): False,
    ("아무 답", "redirect"): True,
    ("통합정보시스템 > 성적 메뉴에서 참고하시기 바랍니다.", "data"): False,
    ("", None): False,
    (None, None): False,
}


def test_redirects_by_hand(spark):
    rows = spark.createDataFrame(list(REDIRECTS), "answer string, declared string")
    for r in rows.select("*", text.is_redirect(F.col("answer"), F.col("declared")).alias("redirect")).collect():
        assert r["redirect"] == REDIRECTS[r["answer"], r["declared"]], r


def test_fixed_lists_are_whole():
    """Sizes counted by hand."""
    assert len(fixed.REDIRECT_MARKERS) == 12 and len(fixed.GLOSSARY) == 134 and len(fixed.NO_CONTEXT) == 15
    assert {k: len(v) for k, v in rules.INTENT_WORDS.items()} == {"ALTERNATIVE": 6, "EARLY_GRADUATION": 14, "GRADUATION_REQ": 25, "REGISTRATION": 47, "SCHEDULE": 19, "MAJOR_CHANGE": 23, "COURSE_INFO": 10, "SCHOLARSHIP": 20, "LEAVE_OF_ABSENCE": 41, "TRANSCRIPT": 9}


@pytest.mark.parametrize("most", [0, terms.DICTIONARY_CHARS])
def test_substring_pairs_by_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "DICTIONARY_CHARS", most)
    texts = [(1, "abcabcd"), (2, ""), (3, None), (4, "bcd"), (5, "x" * 3000 + "abcd" + "y" * 3000)]
    needles = ["abc", "abcd", "bcd", "b", "zz", "", "xy", "abc"]
    found = terms.substring_pairs(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert sorted(map(tuple, found.collect())) == sorted((i, n) for i, t in texts for n in set(needles) - {""} if n in (t or ""))
    if most:  # few needles go to the texts: these aren't cut into n-grams and moved
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
