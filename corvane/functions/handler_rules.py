"""The decision tables of questions about the graph, in their order; answers must agree word by word."""

from corvane.operators.decisions import Handler, Lookup, Rule

GROUP_LABELS = {"2024_2025": "2024학번 이후", "2023": "2023학번", "2022": "2022학번", "2021": "2021학번", "2017_2020": "2017~2020학번", "2016_before": "2016학번 이전"}
#: {unit} tells apart the graphs of several units in one table; it may be empty.
LOOKUPS = {
    "rule": Lookup("reg_{reg_group}{unit}"),
    "before": Lookup("reg_2022이전{unit}"),
    "after": Lookup("reg_2023이후{unit}"),
    "grad": Lookup("grad_{group}_{student_type}{unit}"),
    "foreign": Lookup("grad_{group}_외국인{unit}"),
    "method": Lookup("method_{group}_{major_method}{unit}"),
    "dept": Lookup("dept_{department}{unit}"),
    "season": Lookup("season{unit}"),
    "choice": Lookup("grading_성적선택제{unit}"),
    "ocu": Lookup(of="rule", node_type="OCU"),
}
PRICE = ("수강료", "사용료", "얼마", "금액", "원", "120")
GRADUATION = Handler(
    "GRADUATION_REQ",
    (
        Rule(
            "method", 1.3, text=(("복수전공",),), needs=("method.주전공학점", "method.제2전공학점"),
            answer=("{label}이 {major_method}(주전공+복수전공)으로 졸업할 경우 주전공 {method.주전공학점}학점, 복수전공 {method.제2전공학점}학점을 이수해야 합니다.",),
            context=("[전공이수방법] {major_method} ({group})", "\n- 주전공학점: {method.주전공학점}", "\n- 복수전공학점: {method.제2전공학점}"),
        ),
        Rule(
            "year", 1.4, text=(("졸업",), ("학점", "요건")), unnamed=("major_method", "graduation_cert", "department", "student_groups"), flags=("has_year",), needs=("grad.졸업학점",),
            answer=("{label} {student_type} 학생의 졸업학점은 {grad.졸업학점}학점입니다.",), context=("[{student_id}학번 {student_type} 졸업요건]", "\n- 졸업학점: {grad.졸업학점}"),
        ),
        Rule("topik", 1.25, named=("graduation_cert",), flags=("is_foreign",), needs=("foreign.졸업인증",), answer=("외국인 학생의 졸업인증 TOPIK 기준은 {foreign.졸업인증} 이상입니다.",), context=("[졸업인증]\n- 외국인 TOPIK 기준: {foreign.졸업인증}",)),
        Rule("department_exam", 1.1, named=("department",), needs=("dept.졸업시험_요건",), node="{dept.node_id}"),
        Rule(
            "total", 1.35, text=(("졸업학점",), ("몇", "얼마", "총", "어느")), unnamed=("department",), unflagged=("is_domestic",), needs=("grad.졸업학점",),
            answer=("{student_id}학번 {student_type} 학생의 총 졸업학점은 {grad.졸업학점}학점입니다.",), context=("[{student_id}학번 {student_type} 졸업요건]", "\n- 총 졸업학점: {grad.졸업학점}학점", "\n- 교양이수학점: {grad.교양이수학점}", "\n- 주전공이수학점: {grad.주전공이수학점}"),
        ),
        Rule(
            "total_domestic", 1.35, text=(("졸업학점",), ("몇", "얼마", "총", "어느")), unnamed=("department",), flags=("is_domestic",), needs=("grad.졸업학점",),
            answer=("{student_id}학번 학생의 총 졸업학점은 {grad.졸업학점}학점입니다.",), context=("[{student_id}학번 {student_type} 졸업요건]", "\n- 총 졸업학점: {grad.졸업학점}학점", "\n- 교양이수학점: {grad.교양이수학점}", "\n- 주전공이수학점: {grad.주전공이수학점}"),
        ),
    ),
    (
        Rule("own", 1.0, node="grad_{group}_{student_type}{unit}"),
        *(Rule(f"other_{t}", 0.8, unflagged=(flag,), node=f"grad_{{group}}_{t}{{unit}}") for t, flag in (("내국인", "is_domestic"), ("외국인", "is_foreign"), ("편입생", "is_transfer"))),
        *(Rule(f"method_{i}", 0.95, node=f"method_{{group}}_방법{i}{{unit}}") for i in (1, 2, 3)),
    ),
)
REGISTRATION = Handler(
    "REGISTRATION",
    (
        Rule("on_leave", 1.3, text=(("휴학",), ("수강",)), answer=("휴학생은 수강신청이 불가합니다. 수강신청을 하려면 먼저 복학 신청이 필요합니다.",), context=("[수강신청 유의사항]\n- 휴학 중인 학생은 수강신청 불가\n- 수강신청 전 복학 신청 필요",)),
        Rule("season_both", 1.5, text=(("계절학기", "계절수업"), ("최대", "학점", "취득", "몇")), needs=("season.학기당최대학점", "season.졸업까지최대학점"), answer=("계절학기 한 학기에 최대 {season.학기당최대학점}까지 취득 가능합니다. 졸업까지 최대 {season.졸업까지최대학점}까지 인정됩니다.",), node="{season.node_id}"),
        Rule("season_term", 1.5, text=(("계절학기", "계절수업"), ("최대", "학점", "취득", "몇")), needs=("season.학기당최대학점",), answer=("계절학기 한 학기에 최대 {season.학기당최대학점}까지 취득 가능합니다.",), node="{season.node_id}"),
        Rule("season_total", 1.5, text=(("계절학기", "계절수업"), ("최대", "학점", "취득", "몇")), needs=("season.졸업까지최대학점",), answer=("졸업까지 최대 {season.졸업까지최대학점}까지 인정됩니다.",), node="{season.node_id}"),
        Rule("season", 1.3, text=(("계절학기", "계절수업"),), node="{season.node_id}"),
        Rule("retake_limit", 1.3, text=(("재수강",), ("제한", "한도", "최대")), needs=("rule.재수강제한",), context=("[재수강 제한 규정]\n- {rule.재수강제한}",)),
        Rule(
            "retake_grade", 1.3, text=(("재수강",), ("기준", "가능", "성적")), needs=("rule.재수강기준성적",),
            answer=("재수강은 {rule.재수강기준성적} 과목만 가능합니다.", "재수강 후 받을 수 있는 최고 성적은 {rule.재수강최고성적}입니다."), context=("[재수강 성적 규정]\n- 재수강기준성적: {rule.재수강기준성적}", "\n- 재수강최고성적: {rule.재수강최고성적}"),
        ),
        Rule("grade_choice", 1.3, text=(("성적선택", "성적포기", "부분적 성적"),), node="{choice.node_id}"),
        Rule("grade_choice_np", 1.3, norm=(("p/np", "pnp"),), text=(("신청",),), node="{choice.node_id}"),
        Rule(
            "carry", 1.3, flags=("asks_carry",),
            answer=("2022학번 이전 학번에만 적용되며, 최대 {before.학점이월최대학점}학점까지 이월 가능합니다.", "2023학번 이후 학번에만 적용되며, 최대 {after.학점이월최대학점}학점까지 이월 가능합니다.", "2023학번 이후부터는 {after.학점이월여부|ended}되었습니다."),
            context=("[학점이월제]", "\n- 2022학번 이전: {before.학점이월여부}", "\n  이월 가능 최대학점: {before.학점이월최대학점}학점", "\n- 2023학번 이후: {after.학점이월여부}"),
        ),
        Rule("site", 1.3, norm=(("사이트", "주소", "홈페이지", "url"),), unflagged=("trouble",), needs=("rule.수강신청사이트",), answer=("수강신청 사이트 주소는 {rule.수강신청사이트} 입니다.",), context=("[수강신청]\n- 수강신청사이트: {rule.수강신청사이트}",)),
        Rule("login", 1.3, norm=(("로그인",), ("시간", "언제", "몇시")), unflagged=("trouble",), needs=("rule.로그인오픈시간",), answer=("수강신청 시작 전 {rule.로그인오픈시간}부터 로그인이 가능합니다.",), context=("[수강신청]\n- 로그인오픈시간: {rule.로그인오픈시간}",)),
        Rule("gpa", 1.3, named=("gpa_exception",), needs=("rule.평점4이상최대학점",), answer=("직전학기 평점 4.0 이상인 {reg_label} 학생은 최대 {rule.평점4이상최대학점}학점까지 신청할 수 있습니다.",), context=("[수강신청규칙] {reg_group}\n- 직전학기 평점 4.0 이상 최대학점: {rule.평점4이상최대학점}",)),
        Rule("basket", 1.3, named=("basket_limit",), needs=("rule.장바구니최대학점",), answer=("장바구니에 담을 수 있는 최대 학점은 {rule.장바구니최대학점}학점입니다.",), context=("[수강신청규칙]\n- 장바구니최대학점: {rule.장바구니최대학점}",)),
        Rule("deadline_hour", 1.3, named=("registration_deadline",), needs=("rule.수강취소마감일시|hour",), answer=("수강신청 취소는 {rule.수강취소마감일시|date} {rule.수강취소마감일시|hour}시까지 가능합니다.",), context=("[수강신청 취소]\n- 수강취소마감일시: {rule.수강취소마감일시}",)),
        Rule("deadline", 1.3, named=("registration_deadline",), needs=("rule.수강취소마감일시",), answer=("수강신청 취소는 {rule.수강취소마감일시|date}까지 가능합니다.",), context=("[수강신청 취소]\n- 수강취소마감일시: {rule.수강취소마감일시}",)),
        Rule("ocu_payment", 1.3, named=("payment_period",), flags=("asks_ocu",), needs=("ocu.납부시작", "ocu.납부종료"), answer=("OCU 시스템 사용료 납부기간은 {ocu.납부시작~납부종료}입니다.",), context=("[OCU 납부기간]\n- 납부기간: {ocu.납부시작}~{ocu.납부종료}",)),
        Rule("ocu_excess", 1.3, flags=("asks_ocu",), text=(("초과",),), not_text=PRICE, needs=("ocu.정규학기_최대학점",), answer=("OCU 수강 신청자는 최대 신청학점에서 3학점(1과목) 초과 신청이 가능합니다.",), context=("[OCU 초과학점 예외]\n- OCU 수강 신청자: 최대 신청학점에서 3학점 초과 신청 가능", "\n- OCU 정규학기 최대: {ocu.정규학기_최대학점}학점({ocu.정규학기_최대과목}과목)")),
        Rule("ocu_exception", 1.3, flags=("asks_ocu",), text=(("예외",), ("학점",)), not_text=PRICE, needs=("ocu.정규학기_최대학점",), answer=("OCU 수강 신청자는 최대 신청학점에서 3학점(1과목) 초과 신청이 가능합니다.",), context=("[OCU 초과학점 예외]\n- OCU 수강 신청자: 최대 신청학점에서 3학점 초과 신청 가능", "\n- OCU 정규학기 최대: {ocu.정규학기_최대학점}학점({ocu.정규학기_최대과목}과목)")),
        *(
            Rule(
                f"ocu_most{i}", 1.3, flags=("asks_ocu",), text=(("최대", "몇 학점", "몇학점"), *more), not_text=none, needs=("ocu.정규학기_최대학점",),
                answer=("OCU 정규학기에 수강할 수 있는 최대 학점은 {ocu.정규학기_최대학점}학점({ocu.정규학기_최대과목}과목)입니다. 단, 졸업 시까지 최대 8과목(24학점) 이내로 제한됩니다.",),
                context=("[OCU 정규학기 최대 수강학점]\n- 정규학기: {ocu.정규학기_최대학점}학점({ocu.정규학기_최대과목}과목) 이내\n- 졸업 시까지 누적: 8과목(24학점) 이내",),
            )
            for i, more, none in ((1, (("정규",),), ()), (2, (), PRICE))
        ),
        Rule("ocu_attendance", 1.3, flags=("asks_ocu",), text=(("출석",),), needs=("ocu.출석요건",), answer=("OCU 출석요건은 전체 출석일수의 {ocu.출석요건} 이상입니다.",), context=("[OCU 출석요건]\n- 출석요건: {ocu.출석요건} 이상",)),
        Rule("ocu", 1.2, flags=("asks_ocu",), node="{ocu.node_id}"),
    ),
    (Rule("rule", 1.0, node="{rule.node_id}"),),
    gate=("rule.node_id",),
)
MAJOR_CHANGE = Handler("MAJOR_CHANGE", rest=(Rule("teaching", 1.0, text=(("교직",),), node="teaching_{department}{unit}"), *(Rule(f"method_{i}", 1.0, flags=("has_year",), node=f"method_{{group}}_방법{i}{{unit}}") for i in (1, 2, 3))))
EARLY_GRADUATION = Handler(
    "EARLY_GRADUATION",
    rest=(
        Rule("eligibility", 1.15, node="early_grad_신청자격{unit}"),
        Rule("criteria", 1.2, flags=("has_year",), node="early_grad_기준_{early_group}{unit}"),
        Rule("criteria_before", 1.1, unflagged=("has_year",), node="early_grad_기준_2022이전{unit}"),
        Rule("criteria_after", 1.1, unflagged=("has_year",), node="early_grad_기준_2023이후{unit}"),
        Rule("notes", 0.95, node="early_grad_기타사항{unit}"),
    ),
)
SCHOLARSHIPS = {
    "교내장학금": ("교내장학금",), "근로장학금": ("근로장학금",), "국가장학금": ("국가장학금", "한국장학재단"), "외부장학금": ("외부장학금", "민간장학금"), "성적우수장학금": ("성적우수",),
    "긴급장학금": ("긴급장학금", "긴급생활비", "긴급지원"), "신입생장학금": ("신입생장학금", "입학장학금", "글로벌챌린저", "수능우수"), "외국인장학금": ("외국인장학금", "유학생장학금", "topik", "토픽"),
}
SCHOLARSHIP = Handler("SCHOLARSHIP", rest=tuple(Rule(name, 1.2, norm=(words,), node=f"scholarship_{name}{{unit}}") for name, words in SCHOLARSHIPS.items()), every=("장학금", 1.0, 0))
COURSE_INFO = Handler("COURSE_INFO", rest=(Rule("course", 1.0, named=("course_name",), node="course_{course_name}{unit}"), Rule("department", 0.9, named=("department",), node="{dept.node_id}")))
HANDLERS = (GRADUATION, REGISTRATION, MAJOR_CHANGE, EARLY_GRADUATION, SCHOLARSHIP, COURSE_INFO)
#: Kinds of leave by words of the question; a node tells of a kind if its section has the kind or one of the words.
LEAVE_KINDS = {
    "군입대": ("군입대", "군대", "입대", "군휴학"), "창업": ("창업",), "질병": ("질병", "병원", "의료"), "출산": ("출산", "육아", "임신"), "복학": ("복학", "복귀"), "일반": ("일반휴학", "일반"),
    "전부": ("전부", "전과", "전학과", "학과변경", "학부변경"), "재입학": ("재입학",), "자퇴": ("자퇴", "중도이탈"), "제적": ("제적", "중도이탈"),
}
LEAVE_SCORE, ANY_LEAVE = 1.2, (1.0, 2)
