"""What a student should do next: nine rules over a row of figures for each student."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds, words of required categories, and what counts as missing.
LEAST_SHORTAGE, EXCELLENT, MOST_CREDITS, MOST_EXCELLENT = 0.5, 4.0, 18, 24
REQUIRED, TOTAL = ("필수", "기본", "심화"), "총계"
MISSING_CERTIFICATE, MISSING_EXAM = ("N", "NO", "미이수", ""), ("N", "NO", "미응시", "")
RETAKE_GRADE = "B0"
SEVERITIES = ("error", "warn", "info")


def short(x: Column) -> Column:
    """A number without superfluous zeros."""
    return F.regexp_replace(x.cast("decimal(18,4)").cast("string"), r"\.?0+$", "")


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _missing(checks: Column, signs: tuple[str, ...]) -> Column:
    """The names, sorted, of the entries of a map that aren't done."""
    return F.array_sort(F.transform(F.filter(F.map_entries(checks), lambda e: F.upper(F.coalesce(e["value"], F.lit(""))).isin(*signs)), lambda e: e["key"]))


def student_actions(students: DataFrame, key: str = "student") -> DataFrame:
    """(key, place, type, severity, title, description, target) for a row of each student: errors first, then warnings and notes, then
    by the order of the rules.

    students: categories array of (name, required, acquired, shortage), total_required, total_acquired, total_short; gpa; retake_n,
    retake_credits (courses that may be taken again); retake_used and retake_rule (map; null: none is known); most_credits,
    most_excellent (null: the usual ones); dual_name (null: none), dual_required, dual_acquired, dual_short; can_early (null:
    nothing is known), early_reasons, early_blocked arrays, terms_left; certificates and exams (maps; empty: none).
    """
    c = F.col
    number = lambda x: x.cast("double")

    def action(rule: int, kind: str, severity: Column | str, title: Column, description: Column, target: Column | None = None) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("type"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), title.alias("title"), description.alias("description"), (number(target) if target is not None else F.lit(None).cast("double")).alias("target"))

    def of_category(cat: Column) -> Column:
        needed = F.lit(False)
        for w in REQUIRED:
            needed = needed | cat["name"].contains(w)
        gap = short(cat["shortage"])
        told = _said("현재 ", short(cat["acquired"]), "학점 취득 / 졸업기준 ", short(cat["required"]), "학점 — ", gap, "학점 추가 이수 필요")
        return action(1, "shortage", F.when(needed, "error").otherwise("warn"), _said(cat["name"], " ", gap, "학점 부족"), told, cat["shortage"])

    lacking = F.transform(F.filter("categories", lambda x: (x["name"] != TOTAL) & (x["shortage"] > LEAST_SHORTAGE)), of_category)
    excellent = c("gpa") >= EXCELLENT
    basic, more = F.coalesce("most_credits", F.lit(MOST_CREDITS)), F.coalesce("most_excellent", F.lit(MOST_EXCELLENT))
    gpa = F.format_string("%.2f", F.coalesce("gpa", F.lit(0.0)))
    entries = F.array_sort(F.map_entries("retake_rule"))
    rule_text = F.array_join(F.transform(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: _said(e["key"], ": ", e["value"])), " / ")
    dual = _said("취득 ", short(c("dual_acquired")), " / 기준 ", short(c("dual_required")), "학점")
    certificates, exams = _missing(c("certificates"), MISSING_CERTIFICATE), _missing(c("exams"), MISSING_EXAM)
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ", ")
    count = lambda xs: F.size(xs).cast("string")
    one = [
        (c("total_short") <= 0, action(2, "graduation_ready", "info", F.lit("졸업 학점 요건 충족"), _said("총 ", short(c("total_acquired")), "/", short(c("total_required")), "학점 취득 완료. 졸업인증·졸업시험 등 개별 요건은 학사지원팀 확인."))),
        (c("retake_n") > 0, action(3, "retake", "warn", _said("재수강 후보 ", c("retake_n").cast("string"), "과목 (", short(c("retake_credits")), "학점)"), F.lit(f"{RETAKE_GRADE} 이하 성적 과목 — 평점 향상·졸업 학점 영향 검토 필요"), c("retake_n"))),
        (F.size("retake_rule") > 0, action(4, "retake_limit", "info", _said("재수강 현황 ", short(c("retake_used")), "학점 / 규정 확인"), F.when(rule_text != "", rule_text).otherwise("학번별 재수강 제한 규정 적용"))),
        (excellent, action(5, "registration", "info", _said("다음 학기 최대 ", more.cast("string"), "학점까지 수강 가능"), _said("직전학기 평점 ", gpa, f" ≥ {EXCELLENT} — 우수자 확장 학점 적용"), more)),
        (~F.coalesce(excellent, F.lit(False)), action(5, "registration", "info", _said("다음 학기 기본 최대 ", basic.cast("string"), "학점"), _said("평점 ", gpa, " — 우수자 확장(", more.cast("string"), f"학점) 자격 {EXCELLENT} 이상 필요"), basic)),
        (c("dual_name").isNotNull() & (c("dual_short") > 0), action(6, "dual_major", "warn", _said("복수전공 ", c("dual_name"), " — ", short(c("dual_short")), "학점 부족"), dual, c("dual_short"))),
        (c("dual_name").isNotNull() & (c("dual_short") <= 0), action(6, "dual_major", "info", _said("복수전공 ", c("dual_name"), " 이수 완료"), dual)),
        (c("can_early"), action(7, "early_graduation", "info", F.lit("조기졸업 자격 충족"), F.when(F.size("early_reasons") > 0, F.array_join("early_reasons", " / ")).otherwise("GPA·학점 조건 충족"))),
        (~c("can_early") & (F.size("early_blocked") > 0) & (c("terms_left") <= 2), action(7, "early_graduation", "info", F.lit("조기졸업 자격 미충족"), F.array_join(F.slice("early_blocked", 1, 2), " / "))),
        ((F.size("certificates") > 0) & (F.size(certificates) == 0), action(8, "certification", "info", F.lit("졸업인증 전체 충족"), _said("인증 항목: ", names(c("certificates"))))),
        (F.size(certificates) > 0, action(8, "certification", "error", _said("졸업인증 미충족 ", count(certificates), "항목"), _said("미충족: ", F.array_join(certificates, ", ")), F.size(certificates))),
        ((F.size("exams") > 0) & (F.size(exams) == 0), action(9, "graduation_exam", "info", F.lit("졸업시험 응시 완료"), _said("응시 완료: ", names(c("exams"))))),
        (F.size(exams) > 0, action(9, "graduation_exam", F.when(c("terms_left") <= 1, "error").otherwise("warn"), _said("졸업시험 미응시 ", count(exams), "과정"), _said("미응시: ", F.array_join(exams, ", ")), F.size(exams))),
    ]
    told = F.concat(F.coalesce(lacking, F.array()), F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), a) for holds, a in one))))
    rows = students.select(key, F.posexplode(told).alias("i", "a")).select(key, "i", "a.*")
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order, "rule", "i")).alias("place"), "type", "severity", "title", "description", "target")
