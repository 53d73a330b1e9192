"""Quality rules as a short-circuit cascade.

A rule is a Column that is true for a text to reject, made from the text alone, and a Column for the work it does: about
how many characters it reads, times how often. On a sample each rule's mean work and its selectivity (share rejected)
are measured; rules then run in the order of rejection per work, as the branches of one conditional, so that a text
rejected by an early rule never pays for a later one. Work is counted, not timed, so the order is the same in any run.
It decides only the time and which rule is named first: a text is kept when no rule rejects it, whatever the order.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sample for the rules' order: about so many rows, those whose text's hash is below a threshold.
SAMPLE_ROWS = 2000
_WORD = r"[^\x20\x09-\x0D]+"


class Rule(NamedTuple):
    rejects: Column
    work: Column


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeats(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are sorted with their places, so equal ones are neighbours: n log n in the words of one text.
    """

    def of(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        same = lambda i, j: (i >= 0) & (j < n) & F.coalesce(F.get(sorted_windows, i)["w"] == F.get(sorted_windows, j)["w"], F.lit(False))
        places = F.transform(sorted_windows, lambda s, i: F.when(same(i - 1, i) | same(i, i + 1), s["at"]))
        return F.size(F.array_distinct(F.flatten(F.transform(F.array_compact(places), lambda p: F.array(p, p + 1, p + 2)))))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("at")))
    return F.when(F.size(words) >= 3, _let(F.sort_array(windows(words)), of)).otherwise(0)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measures(text: str = "text") -> dict[str, Column]:
    """Counts of a text; null counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(value, F.lit(_WORD), F.lit(0))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(value, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(value) - F.length(F.translate(value, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": F.when(F.instr(value, "\n") > 0, _dup_lines(value)).otherwise(0).cast("long"),
        "n_repeat_words": _let(words, _repeats).cast("long"),
    }


def standard_rules(text: str = "text", given: Mapping[str, Column] | None = None) -> dict[str, Rule]:
    """Rules over a text; true rejects. given: measures that are there already, whose rules then cost next to nothing."""
    value = F.coalesce(F.col(text), F.lit(""))
    chars = F.length(value).cast("double")
    m = measures(text) | dict(given or {})
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.regexp_count(value, F.lit(r"(?<![^\x20\x09-\x0D])[\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]++(?![^\x20\x09-\x0D])"))
    share = lambda of, is_so, percent: _let(of, lambda x: 100 * F.size(F.filter(x, is_so)) > percent * F.size(x))

    def rule(rejects: Column, passes: float, *needs: str) -> Rule:
        return Rule(rejects, F.lit(1.0) if needs and given and all(n in given for n in needs) else F.lit(passes) * chars + 1)

    return {
        "few_words": rule(m["n_words"] < 50, 3, "n_words"),
        "many_words": rule(m["n_words"] > 100_000, 3, "n_words"),
        "word_length": rule((m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"]), 5, "n_words", "word_chars"),
        "symbols": rule(10 * m["n_symbols"] > m["n_words"], 4, "n_words", "n_symbols"),
        "dup_lines": rule(m["n_dup_lines"] >= 3, 4, "n_dup_lines"),
        "repeats": rule(100 * m["n_repeat_words"] > 50 * m["n_words"], 40, "n_words", "n_repeat_words"),
        # four words in ten without a letter
        "letters": rule(100 * bare > 40 * m["n_words"], 6),
        "bullets": rule(share(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*\u2022]"), 90), 3),
        "cut_off": rule(share(lines, lambda x: x.rlike(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$"), 30), 4),
    }


def order_rules(docs: DataFrame, rules: Mapping[str, Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, mean work, share rejected), the rule with most rejections per work first; equal ones keep their order.

    One pass over the sample, whose rows are summed up where they are read; with no row, rules keep their given order.
    """
    if not rules:
        return []
    every = max(1, docs.count() // max(1, sample_rows))
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0)
    names = list(rules)
    sums = [x for n, r in enumerate(rules.values()) for x in (F.avg(r.work).alias(f"w{n}"), F.avg(F.coalesce(r.rejects, F.lit(False)).cast("int")).alias(f"r{n}"))]
    row = sample.agg(*sums).first()
    found = [(name, row[f"w{n}"] or 1.0, row[f"r{n}"] or 0.0) for n, name in enumerate(names)]
    return sorted(found, key=lambda x: -x[2] / x[1])


def rejected_by(rules: Mapping[str, Rule], names: list[str]) -> Column:
    """The first of the named rules that rejects; later ones aren't evaluated then."""
    verdict = F.lit(None).cast("string")
    for name in reversed(names):
        verdict = F.when(rules[name].rejects, F.lit(name)).otherwise(verdict)
    return verdict


def cascade(docs: DataFrame, rules: Mapping[str, Rule], text: str = "text") -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule of the measured order that rejects a row, else null.

    Rows aren't dropped; null and empty texts go through the rules as empty; repeated rows are judged alike; a
    column ``rejected_by`` is replaced; an empty table gives an empty result.
    """
    docs = docs.drop("rejected_by")
    return docs.withColumn("rejected_by", rejected_by(rules, [name for name, _, _ in order_rules(docs, rules, text)]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = measures()
    # the base counts are asked for here, so they are made once and the rules that need them read them
    counted = docs.select("doc_id", "text", *(c.alias(n) for n, c in counts.items()))
    rules = standard_rules(given={n: F.col(n) for n in counts})
    names = [name for name, _, _ in order_rules(counted, rules)]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.when(failed, F.lit("base")).otherwise(rejected_by(rules, names))
    return counted.select("doc_id", *counts, failed.alias("base_failed"), verdict.alias("rejected_by")).select("doc_id", *counts, "base_failed", F.col("rejected_by").isNull().alias("kept"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT *, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w
), u AS (
  SELECT doc_id, i.i AS i, tri[i.i] AS tr FROM t, unnest(range(1, len(tri) + 1)) AS i(i)
), v AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tr) AS c FROM u
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM v WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, ws, ls, len(ws) AS n_words, length(list_aggregate(ws, 'string_agg', '')) AS wc,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN r USING (doc_id)
), f AS (
  SELECT 100 * len(list_filter(ws, lambda x: NOT regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) > 40 * len(ws)
         OR 100 * len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) > 90 * len(ls)
         OR 100 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) > 30 * len(ls) AS odd,
         doc_id, n_words::BIGINT AS n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
         n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM m
)
SELECT * EXCLUDE (odd), NOT (base_failed OR odd OR n_words > 100000 OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR n_dup_lines >= 3) AS kept FROM f
"""
