"""Decision tables over a small graph, with answers written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import questions
from corvane.operators import handlers

NODES = [
    ("grad_2023_내국인", "졸업요건", {"졸업학점": "120", "교양이수학점": "30"}),
    ("grad_2023_외국인", "졸업요건", {"졸업학점": "118", "졸업인증": "TOPIK 4급"}),
    ("grad_2016_before_내국인", "졸업요건", {"졸업학점": "140"}),
    ("method_2023_방법1", "전공이수방법", {"방법유형": "방법1", "주전공학점": "36", "제2전공학점": "36"}),
    ("reg_2023이후", "수강신청규칙", {"재수강제한": "학기당 6학점", "재수강기준성적": "C+이하", "재수강최고성적": "A", "수강신청사이트": "http://s", "로그인오픈시간": "10분 전", "평점4이상최대학점": "21", "장바구니최대학점": "24", "수강취소마감일시": "2026-03-09 17:00", "학점이월여부": "폐지"}),
    ("reg_2022이전", "수강신청규칙", {"재수강기준성적": "C+이하", "학점이월여부": "최대 3학점", "학점이월최대학점": "3", "수강취소마감일시": "2026-03-09"}),
    ("ocu1", "OCU", {"납부시작": "2026-02-10", "납부종료": "2026-02-13", "정규학기_최대학점": "6", "정규학기_최대과목": "2", "출석요건": "3/4"}),
    ("season", "계절학기", {"학기당최대학점": "6학점", "졸업까지최대학점": "24학점"}),
    ("scholarship_국가장학금", "장학금", {"구분": "국가장학금", "지급액": "1"}),
    ("scholarship_교내장학금", "장학금", {"구분": "교내장학금"}),
    ("early_grad_기준_2023이후", "조기졸업", {"기준학점": "130"}),
    ("early_grad_기준_2022이전", "조기졸업", {"기준학점": "140"}),
    ("leave_a", "휴복학", {"구분": "군입대 휴학"}),
    ("leave_b", "휴복학", {"구분": "자퇴"}),
    ("leave_c", "휴복학", {"구분": "복학"}),
    ("course_미적분학", "교과목", {"학점": "3"}),
]
EDGES = [("reg_2023이후", "ocu1", "has"), ("reg_2022이전", "ocu1", "has"), ("reg_2023이후", "season", "has")]
#: question: intent, and the answers; or the nodes told, with their scores
DIRECT = {
    "2023학번 졸업학점 알려줘": ("GRADUATION_REQ", "2023학번 내국인 학생의 졸업학점은 120학점입니다."),
    "2023학번 유학생 졸업요건": ("GRADUATION_REQ", "2023학번 외국인 학생의 졸업학점은 118학점입니다."),
    "2023학번 유학생 TOPIK 몇 급": ("GRADUATION_REQ", "외국인 학생의 졸업인증 TOPIK 기준은 TOPIK 4급 이상입니다."),
    "2023학번 방법1 복수전공 하려면": ("GRADUATION_REQ", "2023학번이 방법1(주전공+복수전공)으로 졸업할 경우 주전공 36학점, 복수전공 36학점을 이수해야 합니다."),
    "휴학생도 수강신청 되나요": ("REGISTRATION", "휴학생은 수강신청이 불가합니다. 수강신청을 하려면 먼저 복학 신청이 필요합니다."),
    "계절학기 최대 몇": ("REGISTRATION", "계절학기 한 학기에 최대 6학점까지 취득 가능합니다. 졸업까지 최대 24학점까지 인정됩니다."),
    "재수강 가능한 성적은": ("REGISTRATION", "재수강은 C+이하 과목만 가능합니다. 재수강 후 받을 수 있는 최고 성적은 A입니다."),
    "2020학번 재수강 가능한 성적은": ("REGISTRATION", "재수강은 C+이하 과목만 가능합니다."),
    "학점이월 되나요": ("REGISTRATION", "2022학번 이전 학번에만 적용되며, 최대 3학점까지 이월 가능합니다. 2023학번 이후부터는 폐지되었습니다."),
    "수강신청 사이트": ("REGISTRATION", "수강신청 사이트 주소는 http://s 입니다."),
    "로그인은 몇 시": ("REGISTRATION", "수강신청 시작 전 10분 전부터 로그인이 가능합니다."),
    "직전학기 평점 4.0 이상이면": ("REGISTRATION", "직전학기 평점 4.0 이상인 2023학번 이후 학생은 최대 21학점까지 신청할 수 있습니다."),
    "장바구니 한도": ("REGISTRATION", "장바구니에 담을 수 있는 최대 학점은 24학점입니다."),
    "수강 취소는 까지": ("REGISTRATION", "수강신청 취소는 2026년 3월 9일 17시까지 가능합니다."),
    "2020학번 수강 취소 마감": ("REGISTRATION", "수강신청 취소는 2026년 3월 9일까지 가능합니다."),
    "ocu 납부 기간": ("REGISTRATION", "OCU 시스템 사용료 납부기간은 2026년 2월 10일부터 2월 13일까지입니다."),
    "ocu 초과 되나": ("REGISTRATION", "OCU 수강 신청자는 최대 신청학점에서 3학점(1과목) 초과 신청이 가능합니다."),
    "ocu 최대": ("REGISTRATION", "OCU 정규학기에 수강할 수 있는 최대 학점은 6학점(2과목)입니다. 단, 졸업 시까지 최대 8과목(24학점) 이내로 제한됩니다."),
    "ocu 출석": ("REGISTRATION", "OCU 출석요건은 전체 출석일수의 3/4 이상입니다."),
}
TOLD = {
    "수강신청 사이트가 안 돼요": ("REGISTRATION", {"reg_2023이후": 1.0}),
    "ocu 소개": ("REGISTRATION", {"ocu1": 1.2}),
    "2023학번 교양": ("GRADUATION_REQ", {"grad_2023_내국인": 1.0, "grad_2023_외국인": 0.8, "method_2023_방법1": 0.95}),
    "국가장학금 얼마": ("SCHOLARSHIP", {"scholarship_국가장학금": 1.2}),
    "장학금 종류": ("SCHOLARSHIP", {"scholarship_국가장학금": 1.0, "scholarship_교내장학금": 1.0}),
    "2023학번 조기졸업": ("EARLY_GRADUATION", {"early_grad_기준_2023이후": 1.2}),
    "조기졸업": ("EARLY_GRADUATION", {"early_grad_기준_2023이후": 1.1, "early_grad_기준_2022이전": 1.1}),
    "군대 때문에": ("LEAVE_OF_ABSENCE", {"leave_a": 1.2}),
    "중도이탈": ("LEAVE_OF_ABSENCE", {"leave_b": 1.2}),
    "서류": ("LEAVE_OF_ABSENCE", {"leave_a": 1.0, "leave_b": 1.0}),
    "미적분학 과목 정보": ("COURSE_INFO", {"course_미적분학": 1.0}),
    "2023학번 방법": ("MAJOR_CHANGE", {"method_2023_방법1": 1.0}),
    "방법": ("MAJOR_CHANGE", {}),
}


def test_answers_by_hand(spark):
    asked = {q: intent for q, (intent, _) in (DIRECT | TOLD).items()}
    t = F.col("text")
    rows = spark.createDataFrame([(q, intent, q, "") for q, intent in asked.items()], "query_id string, intent string, text string, unit string")
    rows = rows.withColumns({"student_id": questions.student_year(t), "student_type": questions.student_type(t), "entities": questions.entities(t)})
    found = handlers.answers(rows, spark.createDataFrame(NODES, "node_id string, node_type string, attrs map<string,string>"), spark.createDataFrame(EDGES, "src string, dst string, relation string")).collect()
    direct = {r["query_id"]: r["answer"] for r in found if r["answer"]}
    told: dict = {q: {} for q in TOLD}
    for r in found:
        if r["query_id"] in TOLD:
            told[r["query_id"]][r["node_id"]] = r["score"]
    assert direct == {q: a for q, (_, a) in DIRECT.items()}
    assert told == {q: nodes for q, (_, nodes) in TOLD.items()}
    assert {r["context"] for r in found if r["query_id"] == "ocu 소개"} == {"OCU 안내\n- 납부시작: 2026-02-10\n- 납부종료: 2026-02-13\n- 정규학기_최대과목: 2\n- 정규학기_최대학점: 6\n- 출석요건: 3/4"}
