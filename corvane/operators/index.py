"""Keyword index tables and search over them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as text_functions
from corvane.shared import saved


#: Asked terms that are sent to the documents at most; more are joined with the postings.
ASKED_TERMS = 1_000_000
#: Terms of queries that documents are narrowed to at most.
LITERAL_TERMS = 10_000
#: Queries and vectors that a task scores at once.
QUERY_ROWS, VECTOR_ROWS = 256, 4096


class Index(NamedTuple):
    listed: DataFrame  #: doc_id, dl, tokens
    postings: DataFrame  #: term, doc_id, dl, tf
    size: DataFrame  #: one row: n, avgdl


def _postings(listed: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, dl, tf), summed up before it moves; only: the terms wanted, sent to the documents."""
    words = listed.select("doc_id", "dl", F.explode("tokens").alias("term"))
    if only is not None:
        words = words.join(F.broadcast(only), "term")
    return words.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def build_index(docs: DataFrame, key: str = "doc_id", tokens: Column | None = None) -> Index:
    """Tokens, postings and statistics; one shuffle of the distinct (term, document) pairs."""
    listed = docs.select(F.col(key).alias("doc_id"), (tokens if tokens is not None else text_functions.search_tokens(F.col("text"))).alias("tokens"))
    listed = listed.select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens")
    return Index(listed, _postings(listed), listed.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def narrowed(index: Index, queries: DataFrame) -> Index:
    """The index for these queries (query_id, tokens) alone: documents keep their length and only the tokens that are asked for.

    Texts are read once, whatever follows, and what is left of them is saved. More than LITERAL_TERMS terms leave the index as it is.
    """
    only = queries.select(F.explode("tokens").alias("term")).distinct().limit(LITERAL_TERMS + 1).collect()
    if len(only) > LITERAL_TERMS:
        return index
    asked = [r["term"] for r in only]
    listed = saved(index.listed.select("doc_id", "dl", F.filter("tokens", lambda t: t.isin(asked)).alias("tokens")))
    return Index(listed, _postings(listed), listed.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def term_counts(index: Index) -> DataFrame:
    """(term, df, cf): documents that have a term, and times that it comes; summed up by term before anything moves."""
    sorted_ = index.listed.select(F.sort_array("tokens").alias("words"))
    once = F.transform("words", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get("words", i - 1) != t)).alias("first")))
    told = sorted_.select(F.inline(once))
    return told.groupBy("term").agg(F.count_if("first").alias("df"), F.count("*").alias("cf"))


def bm25(index: Index, queries: DataFrame, top: int, k1: float = 1.5, b: float = 0.75, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``top`` documents of each query (query_id, tokens), scores at 6 digits.

    Statistics are of the whole corpus even if ``allowed`` (doc_id) narrows what may be found. Up to ASKED_TERMS asked
    terms are sent to the documents, so that only their postings are made; ties go to the smaller id.
    """
    asked = queries.select("query_id", F.explode("tokens").alias("term"))
    only = asked.select("term").distinct()
    few = only.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS
    postings = _postings(index.listed, only) if few else index.postings.join(only, "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = asked.join(df, "term").crossJoin(F.broadcast(index.size)).join(postings, "term")  # size has one row
    if allowed is not None:
        found = found.join(allowed, "doc_id", "left_semi")
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = found.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return ranked(scored, top)


def ranked(scored: DataFrame, top: int | Column, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The rows of each query_id with rank up to ``top``, by falling score, then by ``tie``."""
    rows = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), tie)))
    return rows.where(F.col("rank") <= top)


def cosine(a: Column, b: Column) -> Column:
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    a, b = wide(a), wide(b)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _merged(kept: tuple[np.ndarray, np.ndarray] | None, scores: np.ndarray, keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The best scores of each row and their keys, of those kept and of new ones in columns by rising key; ties go to the smaller key."""
    if scores.shape[1] > top:  # whole numbers in the same order, all different, as scores have 6 digits
        order = np.rint(np.nan_to_num(scores, nan=-2.0) * 1e6).astype(np.int64) * scores.shape[1] - np.arange(scores.shape[1])
        near = np.argpartition(order, scores.shape[1] - top, axis=1)[:, -top:]
        scores, keys = np.take_along_axis(scores, near, 1), keys[near]
    else:
        keys = np.broadcast_to(keys, scores.shape)
    if kept is not None:
        scores, keys = np.concatenate([kept[0], scores], 1), np.concatenate([kept[1], keys], 1)
    best = np.lexsort((keys, -scores), axis=1)[:, :top]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(keys, best, 1)


def dense(vectors: DataFrame, queries: DataFrame, top: int, key: str = "vec_id", query_rows: int = 10_000) -> DataFrame:
    """(query_id, key, score, rank): exact cosine search of queries (query_id, vector) among vectors (key, embedding).

    The queries are sent to all tasks as a matrix: beyond ``query_rows`` they go in blocks of about so many, by a hash of
    query_id. A task scores QUERY_ROWS x VECTOR_ROWS pairs at a time and keeps each query's best ``top``, which are then ranked over
    all tasks.
    """
    blocks = -(-queries.count() // query_rows)
    parts = [queries] if blocks <= 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()

    def units(column: pa.Array) -> np.ndarray:
        flat = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return flat / np.sqrt((flat * flat).sum(1, keepdims=True))

    def search(part: DataFrame) -> DataFrame:
        asked = part.select("query_id", "vector").toArrow().combine_chunks()  # query_rows, about
        ids, matrix = asked.column("query_id").combine_chunks(), units(asked.column("vector").combine_chunks())

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = range(0, len(ids), QUERY_ROWS)
            kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by the place of a block of queries: scores and keys of all batches so far
            for batch in batches:
                for lo in range(0, batch.num_rows, VECTOR_ROWS):
                    rows = batch.slice(lo, VECTOR_ROWS)
                    rows = rows.take(pc.sort_indices(rows.column(key)))  # so that ties go to the smaller key
                    keys, others = rows.column(key).to_numpy(zero_copy_only=False), units(rows.column("embedding")).T
                    for at in places:
                        kept[at] = _merged(kept.get(at), np.round(matrix[at : at + QUERY_ROWS] @ others, 6), keys.astype(str) if keys.dtype == object else keys, top)
            for at, (scores, keys) in kept.items():
                asker = pa.array(np.repeat(np.arange(at, at + len(scores)), scores.shape[1]))
                yield pa.RecordBatch.from_arrays([ids.take(asker), pa.array(keys.ravel()).cast(batch.column(key).type), pa.array(scores.ravel())], names=["query_id", key, "score"])

        pairs = vectors.select(key, "embedding").mapInArrow(best, f"query_id {kinds[0]}, {key} {kinds[1]}, score double") if len(ids) else None
        return ranked(pairs, top, tie=key) if pairs is not None else ranked(part.select("query_id").crossJoin(vectors.select(key)).withColumn("score", F.lit(0.0)), top, tie=key)

    return reduce(DataFrame.unionByName, map(search, parts))


def _levels(points: DataFrame, point: str, bits: int) -> DataFrame:
    """Points from 0 to 2 ** bits - 1 with the interval of each length that a point lies in: _p (j, at)."""
    p = F.col(point).cast("long")
    held = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda j: F.struct(j.alias("j"), F.call_function("shiftright", p, j).alias("at")))
    return points.where(p.between(0, (1 << bits) - 1)).select("*", F.explode(held).alias("_p"))


def _pieces(ranges: DataFrame, low: str, high: str, bits: int) -> DataFrame:
    """Ranges cut into the fewest intervals of powers of two, two of each length at most: _r (j, at)."""
    lo, hi = F.col(low).cast("long"), F.col(high).cast("long")
    cut = ranges.where(lo <= hi).withColumns({"_lo": F.greatest(lo, F.lit(0)), "_hi": F.least(hi, F.lit((1 << bits) - 1))})

    def of_length(j: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), j)
        holds = lambda k, n: (k * n >= F.col("_lo")) & ((k + 1) * n - 1 <= F.col("_hi"))
        ends = F.array_distinct(F.array(F.floor((F.col("_lo") + size - 1) / size), F.floor((F.col("_hi") + 1) / size) - 1))
        whole = F.filter(ends, lambda k: holds(k, size) & ~((j < bits) & holds(F.floor(k / 2), 2 * size)))
        return F.transform(whole, lambda k: F.struct(j.alias("j"), k.cast("long").alias("at")))

    return cut.select("*", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), of_length))).alias("_r")).drop("_lo", "_hi")


def within_ranges(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, bits: int = 16) -> DataFrame:
    """Rows of points joined with the rows of ranges that hold them (low and high included); whole numbers from 0 to 2 ** bits - 1.

    A range is cut into the fewest intervals of powers of two, two of each length at most, and a point lies in one interval of each
    length: an equality join, without a second check, and without pairs that aren't wanted.
    """
    held, pieces = _levels(points, point, bits), _pieces(ranges, low, high, bits)
    return held.join(pieces, (held["_p.j"] == pieces["_r.j"]) & (held["_p.at"] == pieces["_r.at"])).drop("_p", "_r")


def range_totals(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, value: str, bits: int = 16) -> DataFrame:
    """Rows of points that some range holds, with n, the number of these ranges, and least, the least ``value`` of theirs.

    As ``within_ranges``, but no point meets a range: ranges are counted by interval, of which there are 2 ** (bits + 1) at
    most, and each different point adds up its own, so that the work grows with the two tables and not with their pairs.
    """
    bounds = ranges.groupBy(low, high).agg(F.count("*").alias("_n"), F.min(value).alias("_least"))
    counted = _pieces(bounds, low, high, bits).groupBy("_r").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    held = _levels(points.select(F.col(point).alias("_point")).distinct(), "_point", bits)
    totals = held.join(counted, (held["_p.j"] == counted["_r.j"]) & (held["_p.at"] == counted["_r.at"])).groupBy("_point").agg(F.sum("_n").alias("n"), F.min("_least").alias("least"))
    return points.join(totals, F.col(point) == F.col("_point")).drop("_point")


def metadata_filter(year: Column, doc_types: Column, semester: Column, department: Column | None = None) -> Column:
    """Whether a chunk may be found: its cohort holds the year (unknown years pass), its type is listed (or none is), its semester is empty or the
    same, and its department the one that is asked for, if any."""
    y = year.try_cast("int")
    return (
        (y.isNull() | ((F.col("cohort_from") <= y) & (F.col("cohort_to") >= y)))
        & (F.coalesce(F.size(doc_types), F.lit(0)) <= 0).__or__(F.array_contains(doc_types, F.col("doc_type")))
        & (semester.isNull() | (F.col("semester") == semester) | (F.col("semester") == ""))
        & (F.lit(True) if department is None else F.coalesce(department, F.lit("")).eqNullSafe("") | F.coalesce(F.col("department") == department, F.lit(False)))
    )


def faq_statistics(faqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, idf) over distinct stems of question and answer, and (faq_id, q, a) with their stem sets."""
    stems = lambda c: F.array_distinct(text_functions.stems(F.col(c)))
    sets = faqs.select("faq_id", stems("question").alias("q"), stems("answer").alias("a"))
    n = faqs.agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    df = sets.select(F.explode(F.array_union("q", "a")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", (F.log(F.col("n") / F.col("df")) + 1).alias("idf")), sets


def faq_search(faqs: DataFrame, questions: DataFrame, stopwords: tuple[str, ...], top: int = 5) -> DataFrame:
    """(query_id, faq_id, raw, score, rank, direct) for questions (query_id, question) over faqs (faq_id, question, answer).

    Candidates share an expanded token with the question. Weight: twice the idf of stems shared with the FAQ's question
    and once that of stems shared with its answer, over the root of the number of asked stems, less up to 70% for what
    the FAQ's question asks besides. direct: the first one passes the match and coverage gates.
    """
    idf, sets = faq_statistics(faqs)
    core = lambda c: F.array_distinct(text_functions.core_tokens(F.col(c), stopwords))
    asked = questions.select("query_id", F.when(F.size(core("question")) > 0, core("question")).otherwise(F.array_distinct(text_functions.stems(F.col("question")))).alias("core"), text_functions.match_tokens(F.col("question"), stopwords).alias("keys"))
    n_core = F.size("core")
    keys = asked.select("query_id", F.explode("keys").alias("token"))
    postings = sets.select("faq_id", F.explode(F.array_distinct(F.flatten(F.transform(F.array_union("q", "a"), text_functions.compound_parts)))).alias("token"))
    candidates = keys.join(postings, "token").select("query_id", "faq_id").distinct()
    pairs = candidates.join(asked.select("query_id", "core", n_core.alias("n_core")), "query_id").join(sets, "faq_id")
    stop = F.array(*map(F.lit, stopwords))
    words = pairs.select("query_id", "faq_id", "n_core", F.explode(F.array_union(F.array_union("core", "q"), "a")).alias("token"), "core", "q", "a")
    has = lambda c: F.array_contains(c, F.col("token"))
    weighed = words.join(idf, "token", "left").select(
        "query_id", "faq_id", "n_core", F.coalesce("idf", F.lit(1.0)).alias("w"), has("core").alias("in_core"), has("q").alias("in_q"), has("a").alias("in_a"), (~F.array_contains(stop, F.col("token"))).alias("real")
    )
    total = lambda c, w=1.0: F.sum(F.when(c, F.col("w") * w).otherwise(0.0))
    sums = weighed.groupBy("query_id", "faq_id", "n_core").agg(
        (total(F.col("in_core") & F.col("in_q"), 2.0) + total(F.col("in_core") & F.col("in_a"))).alias("hit"),
        total(F.col("in_q") & F.col("real") & ~F.col("in_core")).alias("extra"),
        total(F.col("in_q") & F.col("real")).alias("asked"),
        total(F.col("in_core"), 3.0).alias("most"),
        F.count_if(F.col("in_core") & (F.col("in_q") | F.col("in_a")) & F.col("real")).alias("covered"),
        F.count_if(F.col("in_core") & F.col("in_q") & F.col("real")).alias("covered_q"),
        F.count_if(F.col("in_core") & F.col("real")).alias("n_real"),
    )
    raw = F.col("hit") / F.sqrt("n_core") * (1 - F.when(F.col("extra") > 0, F.col("extra") / F.col("asked") * 0.7).otherwise(0.0))
    scored = sums.withColumn("raw", F.round(raw, 6)).where("raw > 0").withColumn("score", F.round(F.least(F.col("raw") / F.col("most"), F.lit(1.0)), 6))
    best = ranked(scored, top, score="raw", tie="faq_id")
    strong = (F.col("n_real") >= 3) & (F.col("covered_q") >= 0.9 * F.col("n_real"))
    gate = F.col("raw") >= F.col("most") * F.when(F.col("n_core") == 1, 0.55).when(F.col("n_core") == 2, 0.5).otherwise(0.4)
    covered = F.when(F.col("n_real") > 0, F.col("covered") / F.col("n_real")).otherwise(1.0)
    direct = (F.col("rank") == 1) & (gate | strong) & ((covered >= 0.75) | strong)
    return best.where("score >= 0.1").select("query_id", "faq_id", "raw", "score", "rank", direct.alias("direct"))
