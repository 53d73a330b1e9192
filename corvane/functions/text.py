"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import fixed

TOKEN = "[가-힣A-Za-z]{2,}"
#: The shortest beginning of two characters or more that a suffix completes leaves the longest suffix off.
SUFFIX = "^(.{2,}?)(?:" + "|".join(sorted(fixed.SUFFIXES, key=len, reverse=True)) + ")$"
PRIVATE, FOREIGN, COMBINING, MODIFIERS, CONTROL = r"\x{E000}-\x{F8FF}", r"\x{3400}-\x{4DBF}\x{0250}-\x{02AF}", r"\x{0300}-\x{036F}", r"\x{02B0}-\x{02FF}", r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F"
GARBAGE = f"[{PRIVATE}{FOREIGN}{COMBINING}{MODIFIERS}{CONTROL}]"
#: Patterns of broken characters and what replaces them, in order.
REPAIRS = ((f"[{PRIVATE}]", "■"), (f"[{FOREIGN}]", " "), (f"[{COMBINING}]", ""), (f"[{MODIFIERS}]", ""), (f"[{CONTROL}]", " "), (" {3,}", "  "))


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether the text contains one of the words."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def strip_suffix(token: Column) -> Column:
    return F.regexp_replace(token, SUFFIX, "$1")


def stems(text: Column) -> Column:
    """All suffixes are Hangul, so texts without it keep their tokens as they are."""
    return F.when(text.rlike("[가-힣]"), F.filter(F.transform(tokens(text), strip_suffix), lambda t: F.length(t) >= 2)).otherwise(tokens(text))


def without(words: Column, stopwords: Iterable[str]) -> Column:
    """Words in order, repeats kept, less the stopwords."""
    stop = list(stopwords)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def search_tokens(text: Column) -> Column:
    """Case-sensitive keyword tokens."""
    return without(stems(text), fixed.SEARCH_STOPWORDS)


def core_tokens(text: Column, stopwords: Iterable[str] = fixed.QUESTION_STOPWORDS) -> Column:
    return without(stems(text), stopwords)


def compound_parts(token: Column) -> Column:
    """The token, and its distinct pairs of neighbouring characters if it has four or more."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))
    return F.when(F.length(token) >= 4, F.array_distinct(F.concat(F.array(token), pairs))).otherwise(F.array(token))


def match_tokens(text: Column, stopwords: Iterable[str] = fixed.QUESTION_STOPWORDS) -> Column:
    """The set of stems and of their parts, less the stopwords."""
    return F.array_distinct(without(F.flatten(F.transform(stems(text), compound_parts)), stopwords))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def language(text: Column) -> Column:
    letters = _count(text, "[a-zA-Z가-힣]")
    return F.when(letters == 0, "ko").when(_count(text, "[가-힣ㄱ-ㅎㅏ-ㅣ]") / letters >= 0.3, "ko").otherwise("en")


def normalized(text: Column) -> Column:
    """Lower case, without spaces and punctuation."""
    return F.lower(F.regexp_replace(text, r"[\s\-.,:()\[\]/~·]", ""))


def garbage_ratio(text: Column, is_table: Column | bool = False) -> Column:
    bad = _count(text, GARBAGE)
    whole = F.length(text)
    cells = F.greatest(F.lit(1), whole - _count(text, r"[|\-\s]"))
    table = is_table if isinstance(is_table, Column) else F.lit(is_table)
    return F.when(whole == 0, F.lit(0.0)).otherwise(bad / F.when(table, cells).otherwise(whole))


def repaired(text: Column) -> Column:
    """Broken characters replaced or removed, runs of three spaces and more cut to two."""
    for pattern, new in REPAIRS:
        text = F.regexp_replace(text, pattern, new)
    return text


def without_ocr_markup(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    return F.regexp_replace(text, r"(?i)</?(?:b|i|u|em|strong|sub|sup|small|big|s|mark|del|ins)\s*/?>", "")


def is_redirect(answer: Column, declared: Column) -> Column:
    """Whether an answer only says where to ask; a declared type wins."""
    head = F.substring(answer, 1, 120)
    return F.when(declared == "redirect", True).when(declared == "data", False).otherwise(F.coalesce(any_of(head, fixed.REDIRECT_MARKERS) & ~head.rlike(fixed.CONCRETE), F.lit(False)))


def reports_trouble(question: Column) -> Column:
    return F.coalesce(any_of(F.lower(question), fixed.TROUBLE_SIGNS), F.lit(False))


def is_refusal(answer: Column) -> Column:
    return any_of(answer, fixed.NO_CONTEXT)


def info_type(text: Column) -> Column:
    return (
        F.when(text.rlike(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}"), "schedule")
        .when(text.rlike("https?://"), "contact")
        .when(text.rlike(r"\d+학점|이상|이하|최대|최소|초과"), "requirement")
        .when(text.rlike("신청|절차|방법|제출|서류"), "procedure")
        .otherwise("general")
    )


def tags(title: Column, content: Column) -> Column:
    text = F.concat(title, F.lit(" "), F.substring(content, 1, 300))
    return F.array_compact(F.array(*(F.when(any_of(text, words), F.lit(tag)) for tag, words in fixed.TAGS.items())))


def normalized_url(url: Column) -> Column:
    """Without the page parameter, the other parameters sorted, each once."""
    parts = F.regexp_extract(url, r"^([^?#]*)", 1)
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    mark = F.regexp_extract(url, "(#.*)$", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike("^page(=|$)")))
    return F.concat(parts, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), mark)


def cohort_of_page(text: Column) -> Column:
    """(from, to) of entry years: ranges first, then directions, then single years, else all."""
    year = lambda p, g=1: F.nullif(F.regexp_extract(text, p, g), F.lit("")).cast("int")
    pair = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    named = F.transform(F.regexp_extract_all(text, F.lit("(201[6-9]|202[0-9])학번"), F.lit(1)), lambda y: y.cast("int"))
    both, after, before = "(20[0-9]{2})[~·](20[0-9]{2})학번", r"(20[0-9]{2})학번\s*(?:이후|부터)", r"(20[0-9]{2})학번\s*(?:이전|까지)"
    return (
        F.when(text.rlike(both), pair(year(both), year(both, 2)))
        .when(text.rlike(after), pair(year(after), F.lit(2030)))
        .when(text.rlike(before), pair(F.lit(2016), year(before)))
        .when(F.size(named) > 0, pair(F.array_min(named), F.array_max(named)))
        .otherwise(pair(F.lit(2016), F.lit(2030)))
    )


def cohort_of_chunk(text: Column) -> Column:
    """(from, to) of entry years: named years first, then directions, then ranges, else all."""
    year = lambda p, g=1: F.nullif(F.regexp_extract(text, p, g), F.lit("")).cast("int")
    pair = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    named = F.transform(F.regexp_extract_all(text, F.lit(r"(20[0-9]{2})\s*학번"), F.lit(1)), lambda y: y.cast("int"))
    after, before, both = r"(20[0-9]{2})\s*(?:학년도부터|학번\s*이후|이후|학년도\s*이후)", r"(20[0-9]{2})\s*(?:학번\s*이전|학번까지|이전)", r"(20[0-9]{2})\s*[~\-]\s*(20[0-9]{2})"
    return (
        F.when(F.size(named) > 0, pair(F.array_min(named), F.array_max(named)))
        .when(text.rlike(after), pair(year(after), F.lit(2030)))
        .when(text.rlike(before), pair(F.lit(2016), year(before)))
        .when(text.rlike(both), pair(year(both), year(both, 2)))
        .otherwise(pair(F.lit(2016), F.lit(2030)))
    )


def student_group(year: Column) -> Column:
    """Group of an entry year given as text; what isn't a number counts as 2023."""
    y = year.try_cast("int")
    return F.when(y.isNull(), "2023").when(y >= 2024, "2024_2025").when(y >= 2021, y.cast("string")).when(y >= 2017, "2017_2020").otherwise("2016_before")


def registration_group(year: Column) -> Column:
    return F.when(student_group(year).isin("2023", "2024_2025"), "2023이후").otherwise("2022이전")


def term_start(day: Column) -> Column:
    m, y = F.month(day), F.year(day)
    return F.when(m >= 9, F.make_date(y, F.lit(9), F.lit(1))).when(m >= 2, F.make_date(y, F.lit(2), F.lit(20))).otherwise(F.make_date(y - 1, F.lit(9), F.lit(1)))


def term_label(day: Column) -> Column:
    m, y = F.month(day), F.year(day)
    return F.when(m >= 9, F.concat(y, F.lit("-2"))).when(m >= 2, F.concat(y, F.lit("-1"))).otherwise(F.concat(y - 1, F.lit("-2")))


def post_date(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"[\s.]+", "-"), "-+", "-"), "^-|-$", "")
    century = F.when(plain.rlike("^[0-9]{2}-"), F.concat(F.lit("20"), plain)).otherwise(plain)
    return F.when(plain.rlike(r"^(?:[0-9]{2}|[0-9]{4})-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(century, "yyyy-M-d"))


def academic_year(term: Column) -> Column:
    """(from, to) of an academic year given as text."""
    y = F.when(term.rlike("^[0-9]+$"), term.try_cast("int"))
    return F.struct(F.make_date(y, F.lit(3), F.lit(1)).alias("from"), F.make_date(y + 1, F.lit(2), F.lit(28)).alias("to"))


def expected_units(question: Column) -> Column:
    """Units that a question asks for, sorted."""
    q = F.lower(question)
    found = F.array_distinct(F.flatten(F.array_compact(F.array(*(F.when(any_of(q, words), F.array(*map(F.lit, units))) for words, units in fixed.UNIT_TRIGGERS)))))
    return F.array_sort(F.when((F.size(found) == 0) & q.contains(fixed.AMBIGUOUS_PRICE), F.array(F.lit("won"))).otherwise(found))


def unit_values(text: Column, unit: str) -> Column:
    pattern = (fixed.UNIT_PATTERNS | fixed.UNIT_PATTERNS_AROUND)[unit]
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))
