"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled texts: words whose share among toxic texts is far above that among others,
and stems (beginnings that several such words have in common). It is held in a trie. A token is read by the
product of that trie and a Levenshtein automaton that allows each term a number of edits by its length; the
product is made deterministic as tokens need it, so a token costs one look-up per character. Hits are weighed
by their context window: within quotation marks or beside words that labelled texts show to go with reported
speech they count apart, and a logistic model learns from the labels what each kind of hit is worth.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import _common

SLICE_BYTES = 4 << 20
#: The classifier (lexicon and weights) is learned from so many labelled texts at most, those with the lowest hash of their id.
FIT_ROWS = 10_000
#: Edits allowed to terms of at least so many characters.
EDITS = ((10, 2), (5, 1), (0, 0))
#: The same for tokens of letters and digits, which are seldom a neighbouring word.
MIXED_EDITS = ((10, 2), (4, 1), (0, 0))
_EDIT_BITS = 3
#: Words before and after a hit that make its context.
CONTEXT = 6
#: Size of the automaton at which a worker starts it anew.
REMEMBERED = 500_000
#: Tokens that a worker remembers before it starts anew.
KNOWN = 100_000
_TOKEN = re.compile(r"[^\W_]+")
#: A quotation of any length within a line.
_QUOTED = re.compile('"[^"\n]++"|“[^“”\n]++”|„[^„“\n]++“|«[^«»\n]++»')
# Digits and signs written for letters.
_LEET = str.maketrans("0134578", "oieastb")
FEATURES = ("exact", "exact_quoted", "near", "near_quoted", "stem", "density")


class Term(NamedTuple):
    text: str
    weight: float
    stem: bool


def edits_for(term: Term, edits: tuple = EDITS) -> int:
    return 0 if term.stem else next(e for n, e in edits if len(term.text) >= n)


class Automaton:
    """The deterministic product of the lexicon trie and the terms' Levenshtein automata, built on demand.

    A state is a set of (trie node, edits spent), packed to four bytes each, and the best stem read so far.
    """

    def __init__(self, terms: list[Term], edits: tuple = EDITS) -> None:
        self.allowed = [edits_for(term, edits) for term in terms]
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int]] = [(-1, -1)]  # (term, stem) that end at a node
        self.most = [0]  # edits that some term below allows
        self.terms = terms
        for i, term in enumerate(terms):
            node, path = 0, [0]
            for c in term.text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append((-1, -1))
                    self.most.append(0)
                node = self.child[node][c]
                path.append(node)
            self.ends[node] = (self.ends[node][0], i) if term.stem else (i, self.ends[node][1])
            for x in path:
                self.most[x] = max(self.most[x], self.allowed[i])
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[bytes, int]] = []
        self.step: list[dict[str, int]] = []
        self.verdict: list[tuple[int, int] | None] = []
        self.size = 0
        self.begin = self._state({0: 0}, -1)

    def _state(self, nodes: dict[int, int], stem: int) -> int:
        todo = list(nodes.items())
        for node, e in todo:  # terms' characters that the token lacks
            if e < self.most[node]:
                for nxt in self.child[node].values():
                    if e + 1 <= self.most[nxt] and e + 1 < nodes.get(nxt, 99):
                        nodes[nxt] = e + 1
                        todo.append((nxt, e + 1))
        for node, e in nodes.items():
            if e == 0 and (s := self.ends[node][1]) >= 0:
                stem = s
        key = (array("I", sorted(node << _EDIT_BITS | e for node, e in nodes.items())).tobytes(), stem)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            found = [(e, -self.terms[t].weight, t) for node, e in nodes.items() if (t := self.ends[node][0]) >= 0 and e <= self.allowed[t]]
            self.verdict.append((min(found)[2], min(found)[0]) if found else (stem, -1) if stem >= 0 else None)
            self.size += len(nodes)
        return self.ids[key]

    def _follow(self, at: int, c: str) -> int:
        packed, stem = self.states[at]
        new: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.most[node] and e < new.get(node, 99):
                new[node] = e

        for x in array("I", packed):
            node, e = x >> _EDIT_BITS, x & (1 << _EDIT_BITS) - 1
            if c in self.child[node]:
                put(self.child[node][c], e)
            if e < self.most[node]:
                put(node, e + 1)  # a character too many
                for other, nxt in self.child[node].items():
                    if other != c:
                        put(nxt, e + 1)
        return -1 if not new and stem < 0 else self._state(new, stem)

    def read(self, token: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, the weightier of equally near ones; edits -1: only its stem."""
        at, step = self.begin, self.step
        for c in token:
            nxt = step[at].get(c)
            if nxt is None:
                if self.size > REMEMBERED:
                    self.reset()
                    return self.read(token)
                nxt = step[at][c] = self._follow(at, c)
            if nxt < 0:
                return None
            at = nxt
        return self.verdict[at]


class Reader:
    """Hits and features of texts under a lexicon."""

    def __init__(self, terms: list[Term], cues: frozenset[str]) -> None:
        self.automaton, self.terms, self.cues = Automaton(terms), terms, cues
        self.mixed: Automaton | None = None  # of tokens of letters and digits, once there is one
        self.known: dict[str, tuple[int, int] | None] = {}

    def token(self, token: str) -> tuple[int, int] | None:
        if token.isalpha() or token.isdigit():
            automaton = self.automaton
        else:
            automaton = self.mixed = self.mixed or Automaton(self.terms, MIXED_EDITS)
        found = automaton.read(token)
        if not token.isalpha() and (plain := token.translate(_LEET)) != token and (other := automaton.read(plain)):
            if not found or found[1] < 0 <= other[1]:
                found = (other[0], max(1, other[1]) if other[1] >= 0 else -1)
        return found

    def hits(self, text: str) -> list[tuple[int, int, int, int, bool]]:
        """(start, end, term, edits, quoted) of each hit; offsets are in the lower-cased text."""
        text = text.lower()
        tokens = _TOKEN.findall(text)
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        distinct = set(tokens)
        for t in distinct:
            if t not in known:
                known[t] = self.token(t)
        bad = {t for t in distinct if known[t] is not None}
        if not bad:
            return []
        quoted = [m.span() for m in _QUOTED.finditer(text)]  # in order and apart
        opened = [s for s, _ in quoted]
        out = []
        for i, m in enumerate(_TOKEN.finditer(text)):
            if m[0] in bad:
                term, edits = known[m[0]]
                near = tokens[max(0, i - CONTEXT) : i + CONTEXT + 1]
                at = bisect_right(opened, m.start()) - 1
                reported = at >= 0 and m.start() < quoted[at][1] or not self.cues.isdisjoint(near)
                out.append((m.start(), m.end(), term, edits, reported))
        return out

    def features(self, text: str) -> list[float]:
        sums = [0.0] * 5
        hits = self.hits(text)
        for _, _, term, edits, reported in hits:
            sums[4 if edits < 0 else (0 if edits == 0 else 2) + reported] += self.terms[term].weight
        per = sum(sums[:4:2]) + sums[4]
        return [*(float(np.log1p(x)) for x in sums), float(np.log1p(100 * per / (20 + len(text) / 6)))] if hits else [0.0] * 6


_readers: dict[tuple, Reader] = {}


def reader_of(terms: list[Term], cues: frozenset[str]) -> Reader:
    """A worker's reader of this lexicon; the next tasks of the worker find its automaton grown."""
    key = (tuple(terms), cues)
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(terms, cues)
    return _readers[key]


def _fit(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Logistic weights, the constant first, by damped Newton steps on a small ridge; rows count by their share."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    w[0] = np.log(((y * share).sum() + 0.5) / (((1 - y) * share).sum() + 0.5)) if len(y) else -2.0
    ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (share * p * (1 - p))[:, None]) + ridge, x.T @ (share * (y - p)) - ridge @ w)
        w = w + step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(labels: DataFrame, key: str, label: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(key, y): at most ``fit_rows`` labelled ids whose crc32 mod 5 isn't 0, those with the lowest hash; toxic if any row says so."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0))
    rows = rows.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("key"), "key").limit(fit_rows)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[list[Term], frozenset[str], np.ndarray]:
    """Lexicon, words of reported speech, and logistic weights; see FIT_ROWS for the sample's bound.

    All rows of the sample are learned from. Rows of one label that have the same two words of least hash, as copies and
    near copies mostly do, share one row's weight, lest a copied text's rare words look telling.
    """
    sample = labelled_sample(labels, key, label, fit_rows)
    texts = docs.select(F.col(key).alias("key"), _common.text_or_empty(text).alias("text")).where(F.col("key").isNotNull()).join(F.broadcast(sample), "key")  # fit_rows rows at most
    texts = texts.withColumn("words", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))))
    least = [F.array_min(F.transform("words", lambda w, salt=salt: F.xxhash64(w, F.lit(salt)))) for salt in (1, 2)]
    texts = texts.withColumn("like", F.xxhash64(*least, F.when(F.size("words") == 0, F.col("key"))))
    texts = texts.withColumn("share", 1 / F.count("*").over(Window.partitionBy("like", "y"))).drop("like")
    texts = _common.materialize(texts, "labelled")
    n_bad, n = texts.agg(F.coalesce(F.sum(F.col("share") * F.col("y")), F.lit(0.0)), F.coalesce(F.sum("share"), F.lit(0.0))).first()
    n_bad, n = round(n_bad, 6), round(n, 6)  # sums of shares
    if not n_bad or n_bad == n:
        return [], frozenset(), np.array([-2.0 if not n_bad else 2.0, *[0.0] * len(FEATURES)])
    words = texts.select("y", "share", F.explode("words").alias("w"))
    part = lambda c: F.round(F.sum(c), 6)  # noqa: E731  the same in any order of rows
    seen = words.groupBy("w").agg(part(F.col("share") * F.col("y")).alias("bad"), part("share").alias("of"))
    seen = _common.materialize(seen.where("bad > 0"), "labelled-words")
    n_words = words.select("w").distinct().count()
    odds = F.log((F.col("bad") + 0.1) / (n_bad + 0.2)) - F.log((F.col("of") - F.col("bad") + 0.1) / (n - n_bad + 0.2))
    # so unlikely by chance that among all words seen less than one would get as far
    sure = F.col("bad") * F.log(F.col("bad") / F.col("of") / (n_bad / n)) >= F.log(F.lit(float(max(1, n_words)))) + 2
    words_in = seen.withColumn("weight", odds).where((F.col("bad") >= max(3, 0.01 * n_bad)) & (F.col("weight") >= 3) & sure & (F.col("of") <= 1.3 * F.col("bad")))
    # a stem: a beginning of 4 to 6 letters with three or more words of toxic texts and next to none of others
    ends = seen.where(F.length("w") >= 5).select("bad", "of", "w", F.explode(F.expr("sequence(4, least(6, length(w) - 1))")).alias("k"))
    ends = ends.groupBy(F.expr("substring(w, 1, k)").alias("w")).agg(F.sum("bad").alias("bad"), F.sum("of").alias("of"), F.count("*").alias("n_words")).where("n_words >= 3")
    stems_in = ends.withColumn("weight", odds).where((F.col("bad") >= max(6, 0.02 * n_bad)) & (F.col("weight") >= 4) & sure & (F.col("of") <= 1.05 * F.col("bad")))
    stems: list[Term] = []
    for r in stems_in.orderBy(F.length("w"), "w").collect():  # the sample's words / the least count, at most
        if not any(r["w"].startswith(x.text) for x in stems):
            stems.append(Term(r["w"], float(r["weight"]), True))
    # words stay beside the stems they begin with: a stem allows no edits, its words do
    terms = [Term(r["w"], float(r["weight"]), False) for r in words_in.orderBy("w").collect()] + stems  # bounded alike
    # words that go with hits in clean texts mark reported speech
    beside = _beside(texts.where("y = 0").select("text"), terms)
    hits = beside.where("w = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cues = frozenset(r["w"] for r in beside.where((F.length("w") >= 4) & (F.col("n") >= max(5, 0.1 * hits))).collect())  # 20 * CONTEXT words at most
    rows = _features(texts.select("key", "text", "y", "share"), terms, cues, "text").select("y", "share", *FEATURES).toPandas()
    return terms, cues, _fit(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float), rows["share"].to_numpy(float))


def _beside(texts: DataFrame, terms: list[Term]) -> DataFrame:
    """(w, n): in the context of how many exact hits each word is; the empty word counts the hits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found = reader_of(terms, frozenset()), Counter()
        for part in _common.in_slices(batches, "text", SLICE_BYTES):
            for text in part.column("text").to_pylist():
                low = text.lower()
                for s, e, _, edits, _ in reader.hits(text):
                    if edits == 0:
                        found.update({"", *_TOKEN.findall(low[max(0, s - 400) : s])[-CONTEXT:], *_TOKEN.findall(low[e : e + 400])[:CONTEXT]})
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["w", "n"])

    return texts.mapInArrow(read, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _features(docs: DataFrame, terms: list[Term], cues: frozenset[str], text: str, keep_text: bool = False) -> DataFrame:
    kept = [c for c in docs.columns if keep_text or c != text]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(terms, cues)
        for part in _common.in_slices(batches, text, SLICE_BYTES):
            rows = np.array([reader.features(x or "") for x in part.column(text).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(rows[:, j]) for j in range(len(FEATURES)))], [*kept, *FEATURES])

    schema = docs.select(kept).schema
    for f in FEATURES:
        schema = schema.add(f, "double")
    return _common.bounded(docs).mapInArrow(read, schema)


def _score(weights: np.ndarray) -> Column:
    z = sum((F.lit(float(w)) * F.col(f) for w, f in zip(weights[1:], FEATURES, strict=True)), F.lit(float(weights[0])))
    return 1 / (1 + F.exp(-z))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5; texts pass once and are not shuffled."""
    terms, cues, weights = learn(docs, labels, key, text, label, fit_rows)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no name of a column can then clash with a feature's
    scored = _features(plain, terms, cues, f"c{names.index(text)}", keep_text=True)
    return scored.where(_score(weights) < 0.5).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(key, held_out, score, predicted) for each row of ``docs``.

    score: 0 to 1, from the text alone. Null and empty texts get the score of a text without hits; labels with
    nulls or for unknown ids are ignored, and conflicting ones count as toxic; with no label of either kind every
    score is the same. held_out: the id's crc32 mod 5 is 0; those labels are never used. A null id is not held
    out. Repeated rows get a result each; other columns are ignored; an empty table gives an empty result.
    """
    terms, cues, weights = learn(docs, labels, key, text, label, fit_rows)
    rows = _features(docs.select(F.col(key).alias("key"), _common.text_or_empty(text).alias("text")), terms, cues, "text")
    score = _score(weights)
    held = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rows.select(F.col("key").alias(key), held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
