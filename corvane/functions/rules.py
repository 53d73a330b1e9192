"""Fixed values of question analysis: words and ordered rules that results must agree with."""

# Words for what a question asks.
PERIOD = ("언제", "기간", "일정", "날짜", "날", "일자", "시작", "종료", "마감", "신청일", "며칠")
LIMIT = ("최대", "얼마", "몇 학점", "한도", "제한", "이수 가능", "신청 가능", "수강 가능")
METHOD = ("어떻게", "방법", "절차")
LEAVE = ("휴학", "복학", "전부(과)", "재입학", "자퇴", "제적", "학적변동", "졸업유보", "학사학위취득유예", "학위취득유예", "유예자")
SITE = ("어디서", "어디에서", "어느 사이트", "어느 페이지", "어느 홈페이지", "홈페이지 주소", "어느 기관", "신청 기관", "신청기관", "신청사이트", "신청 사이트", "접속 주소")
QUESTION_WORDS = (
    "어떻게", "언제", "얼마", "몇", "어디", "뭐", "무엇", "왜", "가능", "되나", "할 수", "하나요", "인가요", "인지", "방법", "절차", "서류", "조건", "자격",
    "주소", "사이트", "전화", "번호", "이메일", "알려", "보여", "설명", "찾아", "확인", "궁금", "문의",
)
CONDITIONAL = ("하면", "으면", "면서", "경우", "때", "중에")

# Fixed values: (intent, groups of words of each of which one must occur, words that must not); the first rule that fits decides.
INTENT_RULES = (
    ("EARLY_GRADUATION", (("조기졸업",),), ()),
    ("SCHEDULE", (("장바구니",), PERIOD), ()),
    ("REGISTRATION", (("직전학기", "평점 4.0", "학점이월", "재수강", "장바구니"),), ()),
    ("REGISTRATION", (("ocu",), ("납부", "사용료", "출석", "id")), ()),
    ("REGISTRATION", (("학사경고",), ("학점", "수강신청", "몇", "줄어")), ()),
    ("ALTERNATIVE", (("대체과목", "동일과목"),), ()),
    ("REGISTRATION", (("이수구분",),), ()),
    ("REGISTRATION", (("과목명",), ("동일", "같은", "중복", "코드", "다르")), ()),
    ("SCHEDULE", (("계절학기",), ("기간", "언제", "일정", "확정")), ()),
    ("REGISTRATION", (("계절학기",),), ()),
    ("REGISTRATION", (("졸업유보", "유예"), ("수강", "등록금", "학점")), ()),
    ("GENERAL", (("증명서", "발급", "재학증명", "성적증명", "휴학증명"),), ()),
    ("SCHEDULE", (("전과", "제1·2전공", "제1,2전공", "제2전공"), ("기간", "언제", "일정", "마감")), ()),
    ("SCHEDULE", (("수강신청",), ("기간", "언제", "시작", "마감", "까지", "일자", "스케줄", "날")), ("방법", "어떻게", "어디서", "사이트", "주소", "id", "로그인", "취소하고", "취소 후", "재신청", "초과", "복학생", "처리")),
    ("MAJOR_CHANGE", (("방법1", "방법2", "방법3"),), ()),
    ("MAJOR_CHANGE", (("전과", "전공변경", "학과 변경", "학과변경"),), ("휴학", "복학", "자퇴", "제적")),
    ("LEAVE_OF_ABSENCE", (LEAVE,), ("조기졸업", "수강신청", "수업")),
)
# Words that count for an intent, intents in the order that settles ties.
INTENT_WORDS = {
    "ALTERNATIVE": ("대체", "동일과목", "폐지", "대신", "대체과목", "대체가능"),
    "EARLY_GRADUATION": ("조기졸업", "조기 졸업", "7학기 졸업", "6학기 졸업", "7학기만에", "6학기만에", "조기졸업 신청", "조기졸업 자격", "조기졸업 조건", "조기졸업 기준", "조기졸업 학점", "조기졸업 신청기간", "빨리 졸업", "일찍 졸업"),
    "GRADUATION_REQ": ("졸업", "졸업요건", "졸업학점", "이수학점", "몇 학점", "전공학점", "글로벌소통역량", "취업커뮤니티", "NOMAD", "졸업인증", "졸업시험", "학점인정", "선이수", "성적처리", "성적 처리", "성적기준", "평점산출", "평점계산", "학점계산", "성적이의", "성적정정", "이의신청", "상대평가", "절대평가", "성적평가"),
    "REGISTRATION": ("수강신청", "수강", "재수강", "학점이월", "학점 이월", "이월", "신청가능학점", "최대학점", "신청학점", "취소", "최대신청", "한국열린사이버대학교", "OCU", "장바구니", "납부", "수강신청 정정", "수강정정", "공인결석계", "이수 가능", "신청 가능", "수강 가능", "이수구분", "이수구분 변경", "이수구분 신청", "계절학기", "계절수업", "하계학기", "동계학기", "성적선택", "성적포기", "Pass", "P/NP", "등급제", "자유학기제", "자유학기", "7+1학기", "7+1", "전자출결", "출결", "출석체크", "전자출석", "등록금 반환", "등록금반환", "등록금 환불", "환불기준", "등록금납부", "수업료 반환"),
    "SCHEDULE": ("언제", "기간", "일정", "일자", "스케줄", "마감", "시작일", "종료일", "중간고사", "기말고사", "개강", "종강", "방학", "수강취소", "수업일수", "학사일정", "시험기간", "시험일정", "고사"),
    "MAJOR_CHANGE": ("복수전공", "부전공", "마이크로전공", "전과", "제2전공", "융합전공", "전공탐색", "교직", "제1전공", "단일전공", "방법1", "방법2", "방법3", "이수방법1", "이수방법2", "이수방법3", "주전공+복수전공", "복수전공 이수학점", "전공 변경", "전공변경", "전공을 변경", "전공 바꾸", "학과 변경"),
    "COURSE_INFO": ("과목", "교과목", "수업", "강의", "강의실", "개설", "강좌", "온라인", "대면", "플립"),
    "SCHOLARSHIP": ("장학금", "장학금 신청", "장학금 자격", "장학금 조건", "장학금 신청자격", "장학금 신청기간", "장학금 금액", "등록금 지원", "교내장학금", "근로장학금", "국가장학금", "외부장학금", "민간장학금", "성적우수장학금", "생활비지원", "한국장학재단", "TA장학", "TA장학금", "TA장학생", "교육조교"),
    "LEAVE_OF_ABSENCE": ("휴학", "복학", "휴학 신청", "복학 신청", "일반휴학", "군입대휴학", "군입대 휴학", "창업휴학", "질병휴학", "출산휴학", "육아휴학", "휴학 기간", "복학 기간", "휴학 방법", "휴학 서류", "복학 절차", "휴학신청", "복학신청", "휴학연장", "휴학 취소", "입대 휴학", "전부", "전부(과)", "전학과", "재입학", "재입학 신청", "재입학 조건", "자퇴", "자퇴 신청", "자퇴 방법", "자퇴하고", "제적", "중도이탈", "학적 변동", "학적변동", "졸업유보", "졸업유보자", "학사학위취득유예", "학위취득유예", "유예자", "학사학위취득유예자"),
    "TRANSCRIPT": ("내 성적", "내 학점", "내 평점", "성적표", "부족학점", "뭐가 부족", "재수강 추천", "수강 가능 학점", "복수전공 현황"),
}
# What is asked about, the first that fits; and the question types that follow from it.
FOCUS_RULES = (
    ("table_lookup", (("이론", "실습", "이수과목", "이수학점표"), ("학번", "학년도", "입학"))),
    ("rule_list", (("요건", "자격요건", "이수요건", "조건은", "자격은", "기준은"),)),
    ("period", (PERIOD,)),
    ("limit", (LIMIT,)),
    ("method", (("어떻게", "방법", "절차", "서류", "어디서"),)),
    ("location", (("어디", "어디서", "장소", "건물"),)),
    ("eligibility", (("가능한가", "가능한지", "되나요", "자격", "조건", "요건"),)),
)
FOCUS_TYPES = {"period": "factoid", "limit": "factoid", "table_lookup": "factoid", "rule_list": "factoid", "method": "procedural", "location": "factoid", "eligibility": "reasoning"}
ENTITY_FLAGS = {
    "gpa_exception": ((("직전학기", "평점 4.0"),), ()),
    "basket_limit": ((("장바구니",),), PERIOD),
    "registration_deadline": ((("취소",), ("마감", "까지")), ()),
    "ocu": ((("ocu",),), ()),
    "payment_period": ((("납부",), ("기간",)), ()),
    "second_major_credits": ((("복수전공",), ("이수학점",)), ()),
    "asks_url": ((SITE,), ()),
}
STUDENT_TYPES = (("외국인", ("외국인", "유학생")), ("편입생", ("편입",)))
DEPARTMENTS = (
    "컴퓨터공학", "소프트웨어", "빅데이터", "인공지능", "스마트융합보안", "스마트에너지", "전자", "영어", "일본어", "중국어", "한국어", "독일어", "프랑스어", "스페인어", "러시아어", "베트남어", "태국어", "미얀마어", "아랍", "인도네시아", "인도어", "터키어", "이탈리아어",
    "경영", "경제", "금융", "회계", "무역", "마케팅", "관광", "호텔", "항공", "외교", "행정", "사회복지", "상담심리", "사이버경찰", "영상콘텐츠", "체육", "스포츠", "운동건강", "국제개발", "글로벌창업", "비서",
)
LIBERAL_ARTS = (
    ("인성체험교양", ("채플", "PSC세미나", "사회봉사", "인성체험")), ("기초교양", ("글쓰기", "독서와토론", "기초교양")),
    ("균형교양", ("역사", "철학", "종교", "문학", "문화", "예술", "균형교양")), ("글로벌소통역량", ("글로벌소통", "College English", "AI플러스")),
)
# Signs that a question leans on what was said before.
SINGULAR = ("그거", "이거", "저거", "그것", "이것", "저것", "그게", "이게")
SINGULAR_EN = (" it", " that", " this", "it ", "that ", "this ")
DISTRIBUTIVE = ("각각", "둘 다", "둘다", "셋 다", "셋다", "모두", "다들", "전부", "첫번째", "첫 번째", "두번째", "두 번째", "세번째", "세 번째", "마지막")
DISTRIBUTIVE_EN = (" each ", "each ", " both ", "both ", " all ", "all of ", " first", " second", " third", " last", " former", " latter")
COMPARISON = ("차이", "비교", "다른 점", "다른점", "vs")
COMPARISON_EN = (" difference", " compare", " vs ", " versus ")
ELLIPTIC = ("그럼", "그럼요", "그러면", "그리고", "또", "그런데", "근데")
ELLIPTIC_EN = ("then ", "and ", "but ", "also ")
NEGATION = ("못해", "못 해", "못하", "안돼", "안 돼", "안되", "안 되", "없나", "없어", "없을까", "불가", "안되나")
FEW_WORDS = 5
# Communities of an intent, and the words that add one.
COMMUNITIES = {
    "graduation": ("졸업요건", "학번그룹", "학생유형", "조건", "조기졸업"), "registration": ("수강신청규칙", "학사일정", "계절학기", "OCU"),
    "curriculum": ("교과목", "학과전공", "교양영역", "마이크로전공", "전공이수방법"), "student_status": ("휴복학", "자유학기제"),
    "academic_support": ("장학금", "등록금반환", "전자출결", "성적처리", "교직"), "notices": ("공지사항",), "faq": ("FAQ",),
}
INTENT_COMMUNITIES = {
    "GRADUATION_REQ": ("graduation", "curriculum", "faq", "notices"), "EARLY_GRADUATION": ("graduation", "registration", "faq"), "REGISTRATION": ("registration", "curriculum", "faq", "notices"), "SCHEDULE": ("registration", "notices", "faq"),
    "ALTERNATIVE": ("curriculum", "faq"), "MAJOR_CHANGE": ("curriculum", "faq", "notices"), "COURSE_INFO": ("curriculum", "faq"), "LEAVE_OF_ABSENCE": ("student_status", "faq", "notices"), "SCHOLARSHIP": ("academic_support", "faq", "notices"), "GENERAL": ("faq", "notices", "academic_support"),
}
COMMUNITY_WORDS = (("academic_support", ("교직", "교원자격", "장학", "학비지원", "등록금", "환불", "반환", "출결", "성적처리", "학사경고")), ("student_status", ("자유학기", "7+1")))
# Candidates searched for an intent.
INTENT_CANDIDATES = {"SCHEDULE": 15, "ALTERNATIVE": 10, "GRADUATION_REQ": 15, "REGISTRATION": 15, "EARLY_GRADUATION": 10, "SCHOLARSHIP": 15, "LEAVE_OF_ABSENCE": 15, "COURSE_INFO": 20, "MAJOR_CHANGE": 15, "GENERAL": 15}
FOCUS_WORDS = {"EARLY_GRADUATION": ("조기졸업",), "MAJOR_CHANGE": ("전과", "자유전공"), "LEAVE_OF_ABSENCE": ("휴학",), "SCHOLARSHIP": ("장학", "TA"), "ALTERNATIVE": ("대체과목", "동일과목")}
# Words before which a course is named, words that name one after a blank, and what isn't a course.
COURSE_BEFORE = r"([가-힣A-Za-z0-9]{2,12})\s*(?:대체과목|동일과목|대체가능|대체|대신|과목\s*정보)"
COURSE_WITHIN = r"([가-힣A-Za-z0-9]{2,12})\s+(?:과목|수업|강의)\s"
NOT_COURSES = (
    "어떤", "무슨", "이번", "다른", "해당", "전체", "모든", "각각", "수강신청", "수강", "졸업", "학사", "학점", "성적", "교양",
    "복수전공", "부전공", "제2전공", "마이크로전공", "융합전공",
)
# Which stores a question needs. Intents asked of the graph; intents that need a year of entry; words with
# which a timetable question is asked of texts, too; words that only texts answer, and words that both do.
GRAPH_INTENTS = ("GRADUATION_REQ", "EARLY_GRADUATION", "ALTERNATIVE", "SCHEDULE", "COURSE_INFO", "MAJOR_CHANGE", "REGISTRATION", "SCHOLARSHIP", "LEAVE_OF_ABSENCE", "TRANSCRIPT", "GENERAL")
YEAR_INTENTS = ("GRADUATION_REQ", "MAJOR_CHANGE", "REGISTRATION")
SCHEDULE_TEXT_WORDS = ("교시", "야간수업", "시간표", "강의시간", "성적", "제도", "요건", "조건", "규정", "취소", "마감")
OCU_TEXT_WORDS = ("수강신청", "기간", "신청기간")
TEXT_ONLY_WORDS = ("성적선택", "성적포기", "Pass", "P/NP", "등급제")
BOTH_WORDS = ("성적처리", "평점산출", "평점계산")
