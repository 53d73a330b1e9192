"""Word lists, patterns and weights that results must agree on."""

# Endings stripped from Korean words.
SUFFIXES = (
    "하나요", "있나요", "되나요", "할까요", "되는지요", "는지요", "인지요",
    "한가요", "인가요", "할까", "나요", "가요", "될까",
    "합니까", "입니까", "됩니까", "입니다", "습니다", "합니다", "됩니다",
    "이에요", "예요", "에요", "네요", "해요",
    "하는지", "되는지", "있는지", "인지", "인가", "는가", "해야", "해야죠",
    "으로서", "으로써", "에서도", "부터는", "까지도",
    "으로", "로써", "로서", "에서", "부터", "까지", "에게", "한테", "이랑", "하고", "께서", "에게서",
    "이나", "이며", "이고", "이든", "이던", "조차", "마저",
    "와", "과", "랑", "을", "를", "이", "가", "은", "는", "도", "만", "의", "에", "로", "면", "며", "니", "서", "려", "든",
)
# Words that keyword search leaves out.
SEARCH_STOPWORDS = (
    "그리고", "또한", "그래서", "하지만", "그러나", "따라서", "때문", "대해", "대한", "위해", "위한", "통해", "통한",
    "경우", "이상", "이하", "이내", "이후", "이전", "해당", "관련", "관한", "대하여", "있는", "없는", "하는", "되는",
    "것이", "수가", "바와", "점에", "중에", "무엇", "어떤", "어떻게", "얼마", "언제", "어디",
    "the", "is", "at", "which", "and", "or", "of", "to", "in", "for", "on", "with", "as", "by", "an", "be", "this", "that", "it",
)
# Words that question matching leaves out.
QUESTION_STOPWORDS = (
    "하나요", "있나요", "되나요", "알려", "알려줘", "알려주세요", "해야", "인지", "인가", "는가",
    "뭐야", "뭐", "뭘", "뭔가", "뭐가", "뭔지", "질문", "답변", "문의", "안내",
    "교내", "학교", "캠퍼스", "우리", "어디", "어떻게", "무엇", "언제", "얼마", "점심", "저녁", "아침", "식사",
)
# Signs that an answer only says where to ask.
REDIRECT_MARKERS = (
    "참고하시기 바랍니다", "참고하시기바랍니다", "참고 바랍니다", "문의하시기 바랍니다", "문의 바랍니다", "통합정보시스템 >",
    "홈페이지 >", "아래로 문의", "자세한 내용은", "자세한 사항은", "각 학부(과) 사무실", "해당 부서",
)
CONCRETE = r"\d{2,}\s*학점|\d{4}\s*학?년|\d{4}[.\-]\d{1,2}[.\-]\d{1,2}|\d{1,2}\s*월\s*\d{1,2}\s*일|\d+\s*%|\d+\s*등급|\d+\s*점|\d+\s*시간"
# Signs of a reported fault.
TROUBLE_SIGNS = ("안 됩니다", "안 돼요", "안 돼", "안 되네", "안되요", "안돼요", "되지 않", "되질 않", "안 되", "되지않", "오류", "에러", "error", "문제", "막혀", "막혔", "차단", "거부", "왜 안", "왜안")
# Phrases of an answer that found nothing.
NO_CONTEXT = (
    "확인되지 않는 정보", "제공된 컨텍스트에 없", "관련 정보를 찾을 수 없", "해당 정보가 없", "찾을 수 없습니다", "찾지 못했습니다",
    "확인하지 못했", "답변을 생성하지 못했", "문의하시기 바랍니다", "couldn't find relevant", "could not find relevant",
    "no relevant information", "not available in the provided", "please contact the academic affairs", "+82-51-509-5182",
)
# Topics by keyword.
TAGS = {
    "수강신청": ("수강신청", "수강정정", "수강취소", "수강확인", "장바구니"),
    "장학금": ("장학", "국가장학", "근로장학"),
    "졸업": ("졸업", "졸업시험", "학위수여", "졸업요건"),
    "OCU": ("OCU", "사이버대학", "원격강좌", "군 복무 중"),
    "등록": ("등록안내", "등록금", "납부"),
    "성적": ("성적", "학점인정", "특별강좌"),
    "출결": ("출결", "공인결석"),
    "학생증": ("학생증", "모바일", "국제학생증"),
    "일정": ("개교기념", "휴강", "시험기간", "정전"),
    "휴복학": ("휴학", "복학"),
    "이수구분": ("이수구분", "변경신청"),
    "수업시간표": ("수업시간표", "시간표"),
    "폐강": ("폐강", "폐강과목"),
    "PSC": ("PSC", "세미나"),
    "글소역": ("글로벌소통역량", "영어진단"),
}
# The node type that a topic's notices are linked to.
TAG_NODE_TYPES = {
    "수강신청": "수강신청규칙", "장학금": "장학금", "졸업": "졸업요건", "OCU": "OCU", "등록": "등록금반환",
    "성적": "성적처리", "출결": "전자출결", "휴복학": "휴복학", "일정": "학사일정",
}
# Answer units by trigger words of the question.
UNIT_TRIGGERS = (
    (("학점",), ("credit",)),
    (("몇 과목", "몇과목"), ("course",)),
    (("전화", "번호", "연락처"), ("phone",)),
    (("사이트", "주소", "홈페이지", "url", "포털"), ("url",)),
    (("사무실", "호실", "건물", "어느 동"), ("room",)),
    (("장소", "위치"), ("room", "url")),
    (("언제", "며칠", "날짜", "기간"), ("date", "time")),
    (("몇 시", "몇시"), ("time",)),
    (("성적", "등급"), ("grade",)),
    (("수강료", "수수료", "비용", "금액", "납부"), ("won",)),
    (("어떻게", "방법", "신청은"), ("url",)),
    (("어디",), ("room", "url")),
)
AMBIGUOUS_PRICE = "얼마"
# How each unit looks in a text, the value in the first group.
UNIT_PATTERNS = {
    "credit": r"(\d{1,3})\s*학점",
    "won": r"(\d{1,3}(?:,\d{3})*)\s*원",
    "course": r"(\d+)\s*과목",
    "time": r"(\d{1,2}:\d{2}|\d{1,2}\s*시(?:\s*\d{1,2}\s*분)?)",
    "phone": r"051-?509-?(\d{4})",
    "url": r"(https?://[^\s)\]가-힣]+)",
}
# Units that stand between other signs, and the extension in a line about a department.
UNIT_PATTERNS_AROUND = {
    "date": r"((?:\d{4}\s*년\s*)?\d{1,2}\s*월\s*\d{1,2}\s*일|\d{4}\s*년\s*\d{1,2}\s*월|(?<!\d)\d{1,2}\.\d{1,2}\.?(?!\d))",
    "room": r"(?<![\p{L}\p{N}_])([A-Z]\d{3}(?:-\d+)?)(?![\p{L}\p{N}_])",
    "grade": r"(?<![\p{L}\p{N}_])([A-Da-d](?:\+(?=[\p{L}\p{N}_])|(?![\p{L}\p{N}_])))",
}
EXTENSION = r"(?<!\d)(\d{4})(?!\d)"
# Units that an answer must have where the question asks for them.
REQUIRED_UNITS = ("won", "url", "phone", "room", "grade")
# Signs by which question and answer are told apart. An answer's values of the first kind must be the
# question's, those of the second share one with it; subjects must share one if both have any.
EXACT_SIGNS = {"cohort": r"20\d{2}\s*학번", "year_4": r"(?<!\d)20\d{2}(?!\s*학번)"}
SHARED_SIGNS = {"semester_half": "전기|후기|상반기|하반기", "semester_ord": r"[1-4]\s*학기", "permission": "제한|불가|금지|가능|허용"}
SUBJECT_SIGNS = {"qualification": "자격|요건|기준", "period": "기간|언제|날짜|일정", "action": "신청방법|취소방법|등록방법|제출방법|발급방법|어떻게"}
# What is added to an answer for a unit that it lacks.
UNIT_NOTES = {"phone": "전화: 051-509-{1}", "url": "사이트: {1}", "room": "사무실: {1}", "date": "날짜: {1}", "time": "시간: {1}", "credit": "학점: {1}학점", "won": "금액: {1}원"}
NOTE_HEAD, NOTE_JOIN = "\n\n[참고] ", " / "
# Word pairs of questions, and patterns, that ask for two values.
TWO_VALUE_WORDS = (("복수전공", "이수학점"), ("복수전공", "최소"), ("부전공", "이수학점"), ("제2전공", "이수학점"))
TWO_VALUE_PATTERN = r"(?:주\s*전공|제1\s*전공|본\s*전공)[^\n]*?(?:제2\s*전공|부\s*전공|복수\s*전공|융합\s*전공)|이론[^\n]*?실습|실습[^\n]*?이론|최대[^\n]*?최소|최소[^\n]*?최대|\d\s*학년[^\n]*?\d\s*학년"
#: Least score of a reranked row whose stored answer may be given as it is.
BYPASS_SCORE = 0.2
# Facts read from a context. The question (without blanks) has one word of each group and none of the
# last; then the first pattern found fills the answer. {more} is what FACT_MORE finds besides, if anything.
_RETAKE = ((r"재수강기준성적[:\s]*([A-Da-d][+]?이하)", "{1} 과목만 재수강 가능합니다."), (r"([A-Da-d][+]?)\s*이하[^\n]*?(?:과목|가능|재수강)", "{1} 이하의 과목만 가능합니다."))
FACT_RULES = (
    ((("재수강",), ("가능", "몇")), (), _RETAKE),
    ((("재수강",), ("기준",)), ("제한", "한도", "최대"), _RETAKE),
    ((("출석",), ("요건", "조건", "기준")), (), ((r"(\d+/\d+)\s*이상", "전체 출석일수의 {1} 이상을 충족해야 합니다."), (r"출석요건[:\s]*(\d+/\d+)", "전체 출석일수의 {1} 이상을 충족해야 합니다."))),
    ((("ocu",), ("개강", "시작", "언제")), (), ((r"개강일[:\s]*([\d\-]+)", "OCU 개강일은 {1}{more}입니다."),)),
    ((("몇시", "마감시간", "마감몇시"),), (), ((r"마감[^:]*?(\d{1,2}:\d{2})", "{1}입니다."), (r"(\d{1,2}:\d{2})[^\n]*?마감", "{1}입니다."), (r"시간[:\s]*(\d{1,2}:\d{2})", "{1}입니다."))),
    ((("이론", "실습", "이수과목"),), (), ((r"이론\s*(\d+)\s*(?:학점)?\s*실습\s*(\d+)", "이론 {1}학점, 실습 {2}학점입니다."),)),
    ((("수강료", "비용", "금액", "얼마"),), ("초과",), ((r"(\d{1,3}(?:,\d{3})*)\s*원", "{1}원입니다."),)),
    ((("초과",), ("수강료", "비용", "금액")), (), ((r"초과[^:]*?(\d{1,3}(?:,\d{3})*)\s*원", "초과 수강료는 {1}원입니다."),)),
)
FACT_MORE = r"개강시간[:\s]*(오[전후]\s*\d+시)"
# Words that ask how to reach a department, and the parts of the answer.
REACH_WORDS = ("전화", "연락처", "번호", "사무실", "어디")
REACH_PHONE, REACH_ROOM = "051-509-{1}", "사무실 {1}"
# Grade points and grade ranks.
GRADE_POINTS = {"A+": 4.5, "A": 4.0, "A0": 4.0, "B+": 3.5, "B": 3.0, "B0": 3.0, "C+": 2.5, "C": 2.0, "C0": 2.0, "D+": 1.5, "D": 1.0, "D0": 1.0, "F": 0.0}
GRADE_RANKS = {"A+": 10, "A": 9, "A0": 9, "B+": 8, "B": 7, "B0": 7, "C+": 6, "C": 5, "C0": 5, "D+": 4, "D": 3, "D0": 3, "F": 0, "P": -1, "NP": -2}
# Fixed values: (graph, vector) weights by intent, and their factors by question type.
INTENT_WEIGHTS = {
    "SCHEDULE": (2.0, 0.8), "ALTERNATIVE": (1.2, 1.2), "GRADUATION_REQ": (2.0, 1.3), "REGISTRATION": (1.0, 1.5), "EARLY_GRADUATION": (1.4, 1.3),
    "MAJOR_CHANGE": (1.0, 1.5), "SCHOLARSHIP": (0.8, 1.5), "LEAVE_OF_ABSENCE": (1.0, 1.5), "COURSE_INFO": (0.8, 1.5), "GENERAL": (1.2, 1.3),
}
DEFAULT_WEIGHTS = (1.2, 1.2)
QUESTION_FACTORS = {"overview": (0.8, 1.2), "factoid": (1.0, 1.0), "procedural": (0.9, 1.1), "reasoning": (1.3, 0.7)}
# Context token budgets by intent.
BUDGETS = {
    "SCHEDULE": 1000, "ALTERNATIVE": 800, "GRADUATION_REQ": 1800, "REGISTRATION": 1500, "COURSE_INFO": 1200,
    "SCHOLARSHIP": 1200, "LEAVE_OF_ABSENCE": 1200, "EARLY_GRADUATION": 1600, "MAJOR_CHANGE": 1600, "TRANSCRIPT": 1600,
}
DEFAULT_BUDGET = 1200
# Words of students' own, and the terms they stand for.
GLOSSARY = {
    "복전": "복수전공", "부전": "부전공", "전필": "전공필수", "전선": "전공선택", "교필": "교양필수", "교선": "교양선택", "학고": "학사경고", "재수강": "재수강", "학점넘김": "학점이월", "마이크로": "마이크로전공", "융합": "융합전공", "전과": "전과",
    "전부과": "전과", "전부(과)": "전과", "학과변경": "전과", "학과 변경": "전과", "하계수업": "계절학기", "동계수업": "계절학기", "영문성적증명": "영문 성적증명서", "교양상호인정": "교양전공상호인정", "취커": "취업커뮤니티", "글소역": "글로벌소통역량과정",
    "이수구분변경": "이수구분 변경신청", "이수구분 바꾸기": "이수구분 변경신청", "이수구분 바꾸고": "이수구분 변경신청", "이수구분 바꾸는": "이수구분 변경신청", "전탐": "전공탐색", "PSC": "PSC세미나", "수1/4": "수업일수 1/4선", "추가 수강신청": "수강신청 정정",
    "추가수강신청": "수강신청정정", "수강 정정": "수강신청 정정", "수강변경": "수강신청 정정", "드랍": "수강취소", "졸업식": "학위수여식", "취소하고 다시 수강신청": "수강정정", "취소 후 다시 수강신청": "수강정정", "취소하고 재신청": "수강정정", "취소 후 재신청": "수강정정",
    "다시 수강신청": "수강정정", "재수강신청": "수강정정", "졸시": "졸업시험", "졸업시험": "졸업시험", "공결": "공인결석계", "공인결석": "공인결석계", "학사경고": "학사경고", "성적이의": "성적 이의신청", "성적정정": "성적 정정", "성적공시": "성적확인",
    "성적발표": "성적확인", "성적 언제": "성적확인", "패논패": "Pass/NP 성적선택", "P/NP신청": "성적선택 신청", "패스논패스": "Pass/NP 성적선택", "조기졸신청": "조기졸업 신청", "조기졸업신청": "조기졸업 신청", "7학기졸업": "조기졸업", "6학기졸업": "조기졸업",
    "7학기만에졸업": "조기졸업", "7학기 만에 졸업": "조기졸업", "6학기 만에 졸업": "조기졸업", "7학기만에": "조기졸업", "6학기만에": "조기졸업", "조기졸업조건": "조기졸업 자격", "조기졸업자격": "조기졸업 자격", "조기졸업기준": "조기졸업 졸업기준", "장학": "장학금",
    "장학금신청": "장학금 신청", "교내장학": "교내장학금", "근로장학": "근로장학금", "국가장학": "국가장학금", "외부장학": "외부장학금", "민간장학": "민간장학금", "장학자격": "장학금 신청자격", "장학조건": "장학금 신청자격", "장학금조건": "장학금 신청자격",
    "등록금지원": "등록금 지원", "학비지원": "등록금 지원", "TA장학생": "TA장학생 교육조교", "TA장학": "TA장학 교육조교", "TA 장학": "TA장학 교육조교", "학식": "학생식당", "교식": "학생식당", "교직원 식당": "학생식당", "교직원식당": "학생식당",
    "학생 식당": "학생식당", "식단표": "학생식당 식단표", "오늘 메뉴": "학생식당 메뉴", "오늘메뉴": "학생식당 메뉴", "오늘 밥": "학생식당 메뉴", "오늘 점심": "학생식당 점심 메뉴", "점심 메뉴": "학생식당 메뉴", "점심메뉴": "학생식당 메뉴", "몇학점": "몇 학점",
    "총학점": "총 이수학점", "최소학점": "최소 이수학점", "컴공": "컴퓨터공학과", "영문": "영미언어문화학부", "영문과": "영미언어문화학부", "일문": "일본어학과", "일문과": "일본어학과", "중문": "중국언어문화학부", "중문과": "중국언어문화학부", "불문": "프랑스어학과",
    "불문과": "프랑스어학과", "독문": "독일어학과", "독문과": "독일어학과", "스페인어과": "스페인어학과", "러시아어과": "러시아언어문화학과", "러시아어": "러시아언어문화학과", "소웨": "소프트웨어학부", "솝웹": "소프트웨어학부", "Major Required": "전공필수",
    "Major Elective": "전공선택", "GE": "교양필수", "7+1": "자유학기제", "7+1학기": "자유학기제", "자유학기": "자유학기제", "ocu": "OCU", "오씨유": "OCU", "원격강좌": "OCU", "전자출석": "전자출결", "출석체크": "전자출결",
    "출결시스템": "전자출결", "수업료": "등록금", "등록금환불": "등록금 반환", "등록금반환": "등록금 반환", "등록금취소환불": "등록금 반환", "졸업유보자": "졸업유보", "졸업유보": "졸업유보", "학사학위취득유예자": "학사학위취득유예", "학사학위취득유예": "학사학위취득유예",
    "학위취득유예": "학사학위취득유예", "유예자": "학사학위취득유예",
}
