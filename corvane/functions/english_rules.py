"""Fixed values of the analysis of English questions: words, patterns and their order, that results must agree with."""

# Years of entry.
COHORT = r"(?i)\bclass\s+of\s+(20[12]\d)\b|\b(20[12]\d)\s+(?:student|cohort|enrollment|year)\b"
ADMITTED = r"(?i)\badmitted\s+in\s+(20[12]\d)\b(?!\s+(?:or|and)\s+later)"
SHORT_COHORT = r"(?i)\b([12]\d)\s+(?:cohort|enrollment|admission year|class)\b"
COURSE_NUMBER = r"[A-Z]{2,4}\d{3,4}"
# Student types by pattern.
STUDENT_TYPES = (("외국인", r"(?i)international student|foreign student|exchange student"), ("편입생", r"(?i)transfer student|transfer admission"))
# Words for what a question asks.
PERIOD = ("when", "schedule", "deadline", "period", "date", "start", "end", "until", "from", "by when")
LIMIT = (
    "maximum", "max", "how many credits", "limit", "how much", "up to", "at most", "how many", "minimum", "at least", "minimum credits", "credits required", "credits needed",
    "credits to graduate", "double major credits", "minor credits", "major credits",
)
METHOD = ("how to", "how do i", "procedure", "process", "steps to", "how can i apply", "how to apply", "submit")
LOCATION = ("where", "which office", "which building", "which department", "which place")
ELIGIBILITY = ("eligible", "qualify", "qualified", "can i", "am i able", "is it possible", "allowed to")
TABLE = ("table", "chart", "by year", "by cohort", "comparison", "credits required per", "breakdown")
TABLE_YEAR = ("cohort", "enrollment year", "year of admission")
RULE_LIST = ("requirements", "qualifications", "conditions", "criteria", "what are the requirements", "what do i need", "rules for")
#: What is asked about, the first that fits.
FOCUS_RULES = (("table_lookup", (TABLE, TABLE_YEAR)), ("rule_list", (RULE_LIST,)), ("limit", (LIMIT,)), ("method", (METHOD,)), ("location", (LOCATION,)), ("period", (PERIOD,)), ("eligibility", (ELIGIBILITY,)))
NO_PERIOD = ("what changed", "changed in", "changed starting", "starting from the", "from the 20")
# What a question names. Flags: words, words that must not occur, or a second group.
OCU = ("ocu", "open cyber university", "cyber university consortium")
GPA = ("gpa 4.0", "4.0 gpa", "grade point average 4", "prior semester gpa", "previous semester gpa")
BASKET = ("wish list", "basket", "shopping cart", "pre-registration cart")
PAYMENT = ("tuition payment", "tuition fee payment", "pay tuition", "payment deadline", "fee payment")
SECOND_MAJOR = ("double major credit", "double major requirement", "minor credit", "second major credit", "dual major credit")
SITE = (
    "where can i", "where do i", "which website", "what website", "what site", "what is the website", "what is the url", "what is the link",
    "online portal", "apply online", "register online", "access online", "which portal", "where to apply", "where to register",
)
CANCEL = ("cancel", "drop", "withdraw", "unenroll", "un-enroll")
LATEST = ("by when", "deadline", "last day", "cutoff", "until when", "how long", "last date")
ENTITY_FLAGS = {
    "ocu": ((OCU,), ()), "gpa_exception": ((GPA,), ()), "basket_limit": ((BASKET,), PERIOD), "payment_period": ((PAYMENT,), ()),
    "second_major_credits": ((SECOND_MAJOR,), ()), "asks_url": ((SITE,), ()), "registration_deadline": ((CANCEL, LATEST), ()),
}
CERTIFICATES = ("topik", "toeic", "toefl", "ielts", "language proficiency", "english proficiency")
UPPER_CERTIFICATES = ("topik", "toeic", "toefl", "ielts")
MAJOR_METHODS = (("method 1", "방법1"), ("method 2", "방법2"), ("method 3", "방법3"))
MAJOR_CONTEXT = ("major", "double", "minor", "second major", "track")
MAJOR_OPTIONS = (("option 1", "방법1"), ("track 1", "방법1"), ("option 2", "방법2"), ("track 2", "방법2"), ("option 3", "방법3"), ("track 3", "방법3"))
HALVES = (("전기", ("first semester", "spring semester", "1st semester", "first-semester", "semester 1")), ("후기", ("second semester", "fall semester", "autumn semester", "2nd semester", "second-semester", "semester 2")))
LIBERAL_ARTS = (
    ("인성체험교양", ("chapel", "psc seminar", "social service", "volunteer", "community service", "character education")),
    ("기초교양", ("academic writing", "writing course", "reading and discussion", "basic liberal arts", "writing class")),
    ("균형교양", ("general education", "liberal arts", "humanities course", "balanced liberal arts", "cultural studies")),
    ("글로벌소통역량", ("global communication", "college english", "ai plus", "global literacy", "english communication")),
)
# Korean search words added for what is asked, for phrases, and for transfer students.
FOCUS_TERMS = {"period": "신청기간", "location": "확인", "eligibility": "자격", "rule_list": "기준"}
PHRASE_TERMS = ((("application period", "application window"), "신청기간"), (("where do you apply", "where can i apply"), "신청"))
TRANSFER, TRANSFER_TERMS = "편입생", ("편입학생", "교육과정 이수방법")
# Equivalents of courses that are retaken; choices of grading.
EQUIVALENTS, RETAKE = ("alternative course", "equivalent course", "same course"), "retake"
GRADE_CHOICE = (
    "pass/fail", "pass or fail", "p/np", "pass/np", "pass non-pass", "non-pass", "np grade", "grade option", "grade selection", "grade waiver", "grade mode", "satisfactory", "s/u grade",
    "grade conversion", "pass fail conversion", "retake", "retaken", "retaking", "grade cancel", "grade cancellation", "partial grade", "partial waiver",
)
