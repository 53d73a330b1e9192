"""Personal data by offset-preserving deobfuscation.

Transducers read a text from left to right, once each, and carry for every character they emit the source range it
stands for. The first writes look-alike and compatibility forms as ASCII and drops invisible characters, the second
writes spelled digits as digits, the third reads names, numbers and the signs between them (at, dot and their bracketed,
spelled and spaced-out disguises) as chains. Identifiers are detected in the source, in the rewritten text and in the
chains; spans of the latter are mapped back. Every pass takes time in proportion to the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _common

SLICE_BYTES = 4 << 20
KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, those that could scan one place twice in possessive parts.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones; signs that do; what has no width.
LOOKALIKE = dict(zip("аеорсухіјѕԁһⅼոցеАВЕКМНОРСТУХІЈЅοαενικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlngeABEKMHOPCTYXIJSoaevikptuxABEZHIKMNOPTYX", strict=True)) | {"。": ".", "․": "."}
# Digit names.
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}

_NAME = "|".join(sorted(DIGITS, key=len, reverse=True))
_TIMES = {"double": 2, "triple": 3}
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:plus|double|triple|{_NAME}|[0-9]++)(?![^\W_])")
_GAP = re.compile(r"[\s,;._-]{1,3}")
_ARTICLE = "un"  # a digit's name that is an article, too: a cue only beside another number
_SPELLED_CUE = re.compile(rf"(?i)(?<![^\W_])(?:(?!{_ARTICLE}(?![^\W_]))(?:{_NAME})(?![^\W_])|{_ARTICLE}[\s,;._-]{{1,3}}(?:[0-9]|{_ARTICLE}(?![^\W_]))|[0-9]++[\s,;._-]{{1,3}}{_ARTICLE}(?![^\W_]))")
#: Items of a run of spelled digits at least.
SPELLED_ITEMS = 4
_AT = r"(?:at|@|arroba|chez)"
_DOT = r"(?:dot|\.|punkt|point|punto)"
#: A chain's parts in the order they are tried; blanks that are no part of a sign are passed in one piece.
_CHAIN = re.compile(
    rf"(?i)(?P<at_sign>\s*+[\[({{<]\s*+{_AT}\s*+[\])}}>]\s*+)|(?P<dot_sign>\s*+[\[({{<]\s*+{_DOT}\s*+[\])}}>]\s*+)"
    r"|(?P<at_word>\s++(?:at|arroba)\s++)|(?P<dot_word>\s++dot\s++)|(?P<dot_punkt>\s++punkt\s++)|(?P<dot_point>\s++point\s++)|(?P<dot_punto>\s++punto\s++)|(?P<at_apart>\s++@\s*+|@\s++)|(?P<dot_apart>\s++\.\s*+)"
    r"|(?P<at>@)|(?P<dot>\.)|(?P<atom>[A-Za-z0-9_%+-]++)|\s++"
)
# Ends of addresses by which other languages' words for a dot are told from the words themselves.
TOPS = {"dot_punkt": ("com", "net", "org", "info", "eu", "de", "at", "ch"), "dot_point": ("com", "net", "org", "info", "eu", "fr"), "dot_punto": ("com", "net", "org", "info", "eu", "es", "it", "mx", "ar")}
_BESIDE_DOT = re.compile(r"(?i)\s++(?:dot|punkt|point|punto)\s|\s*+[\[({<]\s*+(?:dot|\.|punkt|point|punto)\s*+[\])}>]")
_AFTER_DOT = re.compile(r"(?i)(?:\s(?:dot|punkt|point|punto)\s|[\])}>]\s?)$")
_CHAIN_CUE = re.compile(r"(?i)[\[({<]\s*+(?:at|@|arroba|chez|dot|\.|punkt|point|punto)\s*+[\])}>]|\sdot\s|\sarroba\s|\s(?:punkt|point|punto)\s++(?:[0-9]++|com|net|org|info|eu|de|at|ch|fr|es|it|mx|ar)(?![^\W_])|\sat\s++[a-z0-9.-]++(?<=[a-z0-9.]{4})|\s@|@\s")
# Words that stand before "at" and a web site.
_PROSE = frozenset(
    "me us you him her them it we i he she they look looks looked looking visit visited see seen find found available here there live lives online"
    " site website page pages blog store shop home hosted host posted published register registered sign signup join read more info information"
    " details detail contact order ordered buy bought download downloads downloaded check is are was were be being been and or but not now only also"
    " out up down back over start starts started starting arrive arrived located location based work works worked working employee engineer developer"
    " developers ceo founder editor team staff people customers users support service services help again today tomorrow directly free guide article"
    " story post link links listed list document documents documentation docs code source sources project video videos photos images news report"
    " reports data study map login account accounts click go going get getting meet met stay sold sale prices price products product tickets apply"
    " course courses jobs job career careers forum question questions try tool tools update updated version that this these those one all any best"
    " first last yourself themselves mail email e-mail write".split()
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """From each sign back to where its local part begins, and on over its domain."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = free + len(text[free:at].rstrip(LOCAL))
        free = at + 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            found.append((begin, m.end()))
            free = m.end()
        at = text.find("@", free)
    return found


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the identifiers as written, by kind and start; leftmost and apart within a kind."""
    found = [(0, s, e) for s, e in _emails(text)]
    if any(d in text for d in "0123456789"):
        for m in NUMBERS.finditer(text):
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(map(_small, four)):
                    found.append((1, at, end))
                at = end + 1
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


@cache
def _plain(c: str) -> str | None:
    """What a character stands for, if it isn't itself."""
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if kind in ("Zs", "Pd"):
        return " " if kind == "Zs" else "-"
    found = unicodedata.normalize("NFKC", c)
    return found if found.isascii() and (found.isalnum() or found in "@.+()[]<>{}_%") else None


class Tape:
    """A rewritten text with, per character, the source range it stands for and whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = np.arange(len(text), dtype=np.int32)
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put other characters in places (start, end), in order and apart; each stands for the whole place."""
        if not edits:
            return
        lo, hi = (np.array([x[i] for x in edits]) for i in (0, 1))
        text, last = [], 0
        for begin, end, new in edits:
            text += [self.text[last:begin], new]
            last = end
        text.append(self.text[last:])
        size = np.array([len(x) for x in text])  # kept and put in by turns
        part = np.repeat(np.arange(len(size)), size)
        put = part % 2 == 1
        kept = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + np.concatenate([[0], hi])[part // 2]
        first, final = (np.where(put, np.append(x, 0)[part // 2], kept) for x in (lo, hi - 1))
        self.text = "".join(text)
        self.start, self.end, self.changed = self.start[first], self.end[final], self.changed[np.minimum(kept, len(self.changed) - 1)] | put

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        return int(self.start[lo]), int(self.end[hi - 1])


_NOT_ASCII = re.compile(r"[^\x00-\x7F]")


def _look_alikes(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), new) for m in _NOT_ASCII.finditer(text) if (new := _plain(m[0])) is not None]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs of digit names, with digits between them, as digits; "double" and "triple" repeat the next."""
    edits: list[tuple[int, int, str]] = []
    run: list[re.Match] = []

    def close() -> None:
        while run and run[-1][0].lower() in (*_TIMES, "plus"):
            run.pop()
        named = [i for i, m in enumerate(run) if m[0].lower() in DIGITS]
        # few digits count as a part of an address between spoken dots
        if named and (len(run) - named[0] >= SPELLED_ITEMS or _BESIDE_DOT.match(text, run[-1].end()) or _AFTER_DOT.search(text, max(0, run[0].start() - 8), run[0].start())):
            out, times = [], 1
            for m in run:
                word = m[0].lower()
                if word in _TIMES:
                    times = _TIMES[word]
                else:
                    out.append("+" if word == "plus" else str(DIGITS.get(word, word)) * times)
                    times = 1
            edits.append((run[0].start(), run[-1].end(), "".join(out)))
        run.clear()

    for m, after in pairwise(chain(_SPELLED.finditer(text), [None])):
        gap = text[run[-1].end() : m.start()] if run else ""
        if run and (m[0].lower() == "plus" or not _GAP.fullmatch(gap)):
            close()
        elif run and m[0].lower() == _ARTICLE:
            # it counts after a plus, before a dot, or if it is set apart as the digits before or after it are
            same = run[-1][0].lower() == "plus" or _BESIDE_DOT.match(text, m.end()) or gap == (text[run[-2].end() : run[-1].start()] if len(run) > 1 else " ")
            if not same and not (after and gap == text[m.end() : after.start()]):
                close()
        run.append(m)
    close()
    return edits


def _chains(text: str) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """Maximal chains: (start, end) of atoms, and the kinds of the signs between them."""
    atoms: list[tuple[int, int]] = []
    signs: list[str] = []
    upto = 0
    for m in _CHAIN.finditer(text):
        kind = m.lastgroup
        if m.start() != upto or kind is None or (kind == "atom") == (len(atoms) > len(signs)):
            if len(atoms) > 1:
                yield atoms, signs[: len(atoms) - 1]
            atoms, signs = [], []
        if kind == "atom":
            atoms.append(m.span())
        elif kind and atoms:
            signs.append(kind)
        upto = m.end()
    if len(atoms) > 1:
        yield atoms, signs[: len(atoms) - 1]


def _of_chain(text: str, atoms: list[tuple[int, int]], signs: list[str]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the addresses in a chain that has a disguised sign."""
    last = -1  # the last atom taken
    for i, sign in enumerate(signs):
        if not sign.startswith("at") or i <= last:
            continue
        spoken = sign == "at_word"
        dots = {"dot", "dot_sign", "dot_word", *TOPS} | ({"dot_apart"} if sign == "at_apart" else set())
        lo, hi = i, i + 1
        while lo > last + 1 and signs[lo - 1] in dots:
            lo -= 1
        while hi < len(signs) and signs[hi] in dots:
            hi += 1
        used = signs[lo:hi]
        if hi == i + 1 or set(used) <= {"at", "dot"}:
            continue
        top, other = text[slice(*atoms[hi])], TOPS.keys() & signs[lo:hi]
        if any(top.lower() not in TOPS[x] for x in other):
            continue
        if spoken and set(signs[i + 1 : hi]) <= {"dot", *TOPS}:  # a bare "at" before a host whose dots aren't disguised, or may be a word of prose
            name = text[atoms[lo][0] : atoms[i][1]].lower()
            if name in _PROSE or not any(c.isalpha() for c in name) or not (top.isalpha() and len(top) >= 2):
                continue
        yield 0, atoms[lo][0], atoms[hi][1]
        last = hi
    i = 0
    while i + 3 < len(atoms):
        four = [text[s:e] for s, e in atoms[i : i + 4]]
        if all(s.startswith("dot") for s in signs[i : i + 3]) and all(x.isdecimal() for x in four):
            if all(map(_small, four)) and set(signs[i : i + 3]) != {"dot"}:
                yield 1, atoms[i][0], atoms[i + 3][1]
            i += 4
        else:
            i += 1


def disguised(text: str) -> list[tuple[int, int, int]]:
    """Identifiers that only show after rewriting, as source ranges (their disguise included)."""
    tape, found = None, []
    for cue, edits_of in ((_NOT_ASCII, _look_alikes), (_SPELLED_CUE, _spelled)):
        read = tape.text if tape else text
        if cue.search(read) and (edits := edits_of(read)):
            tape = tape or Tape(text)
            tape.replace(edits)
    if tape:
        for kind, lo, hi in detect(tape.text):
            s, e = tape.source(lo, hi)
            if e - s != hi - lo or tape.changed[lo:hi].any():
                found.append((kind, s, e))
    read = tape.text if tape else text
    if _CHAIN_CUE.search(read):
        for atoms, signs in _chains(read):
            if set(signs) <= {"at", "dot"}:
                continue
            for kind, lo, hi in _of_chain(read, atoms, signs):
                found.append((kind, *(tape.source(lo, hi) if tape else (lo, hi))))
    return found


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The identifiers as written, and all with the disguised ones that aren't within one of their kind.

    A disguised identifier of which a part looks plain is longer than the base span in it; both are given.
    """
    base = detect(text)
    wide = {k: np.array([(s, e) for x, s, e in base if x == k], np.int64).reshape(-1, 2) for k in range(len(KINDS))}
    more = []
    for kind, s, e in disguised(text):
        at = int(np.searchsorted(wide[kind][:, 0], s, side="right")) - 1  # base spans of a kind lie apart
        if at < 0 or wide[kind][at, 1] < e:
            more.append((kind, s, e))
    return base, sorted({*base, *more})


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end) in code points, end exclusive.

    base: identifiers as written. spans: those and the disguised ones, by kind (email, ip, card, phone) and start.
    Null and empty texts have none; repeated rows are scanned alike; other columns stay, but columns named
    ``base`` or ``spans`` are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("base", "spans")
    kept = docs.columns

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _common.in_slices(batches, text, SLICE_BYTES):
            both = [scan(x or "") for x in part.column(text).to_pylist()]
            as_rows = [[[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in side] for side in zip(*both, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, _SPANS) for x in as_rows)], [*kept, "base", "spans"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    return _common.bounded(docs).mapInArrow(spans, docs.select("*", F.lit(None).cast(kind).alias("base"), F.lit(None).cast(kind).alias("spans")).schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every identifier in ``text`` replaced by its kind in angle brackets; null stays null."""
    kept = docs.columns

    def masked(value: str) -> str:
        out, last = [], 0
        for kind, start, end in sorted(scan(value)[1], key=lambda x: (x[1], -x[2])):
            if start >= last:
                out += [value[last:start], f"<{KINDS[kind]}>"]
            else:  # overlaps another identifier; both go
                start = last
            last = max(last, end)
        return "".join([*out, value[last:]])

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index(text)
        for part in _common.in_slices(batches, text, SLICE_BYTES):
            new = pa.array([x if x is None else masked(x) for x in part.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(part.columns)], kept)

    return _common.bounded(docs).mapInArrow(mask, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(docs).select("doc_id", *map(count, KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
