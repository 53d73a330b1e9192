"""Greedy clustering by heads: an item joins the first head that it resembles, or becomes a head itself.

The choice depends on the order of all items, yet is found without a loop over them. Items meet by the rare words that
two similar sets must share (prefix filter). The first of all items under each of its words is a head for certain, and
each word has at most one such head, so a round that compares these with all others makes no more pairs than there are
words. A few rounds take large groups of copies away; what is left becomes a graph of similar pairs, which is decided
from its first items on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.shared import saved

#: Rounds by words before pairs are made.
ROUNDS = 3
#: So many undecided pairs are decided by one task, in order.
SMALL = 200_000


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """(place, n, tokens, sign, lead) of sets (place, tokens): the words from rare to frequent; ``lead``: as many as a set of
    that size can't miss all of, without those that no other set has; ``sign``: the parity of the words by 256 hashed classes."""
    words = sets.select("place", F.explode("tokens").alias("token"))
    often = words.groupBy("token").agg(F.count("*").alias("often"))
    at = F.xxhash64("token")
    parity = lambda i: F.bit_xor(F.when(at.bitwiseAND(3) == i, F.expr("shiftleft(1L, cast(shiftright(xxhash64(token), 2) & 63 AS int))")).otherwise(F.lit(0).cast("long")))
    of = words.join(often, "token").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("w"), *(parity(i).alias(f"s{i}") for i in range(4)))
    n = F.size("w")
    needed = F.floor((percent * n + 99) / 100)
    shared = F.filter(F.slice(F.transform("w", lambda w, i: F.struct((i + 1).alias("i"), w["often"].alias("often"), w["token"].alias("token"))), F.lit(1), (n - needed + 1).cast("int")), lambda w: w["often"] > 1)
    return of.select("place", n.alias("n"), F.transform("w", lambda w: w["token"]).alias("tokens"), F.struct(*(f"s{i}" for i in range(4))).alias("sign"), F.transform(shared, lambda w: F.struct(w["i"].alias("i"), w["token"].alias("token"))).alias("lead"))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets share enough."""
    a, b = (sets.select(F.col("place").alias(x), F.col("tokens").alias(f"{x}_tokens"), F.col("n").alias(f"{x}_n")) for x in "ab")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.col("a_n") + F.col("b_n") - both)).select("a", "b")


def _possible(percent: int) -> Column:
    """Whether sets a and b that meet by a word may be similar: by their sizes; by what is left from that word on, if it is
    the first that they share; and by their parities, which differ in no more classes than the sets do in words."""
    a, b = F.col("a_n"), F.col("b_n")
    sized = (100 * a >= percent * b) & (100 * b >= percent * a)
    left = (100 + percent) * (1 + F.least(a - F.col("a_i"), b - F.col("b_i"))) >= percent * (a + b)
    apart = sum((F.bit_count(F.col(f"a_sign.s{i}").bitwiseXOR(F.col(f"b_sign.s{i}"))) for i in range(1, 4)), F.bit_count(F.col("a_sign.s0").bitwiseXOR(F.col("b_sign.s0"))))
    return sized & left & ((100 + percent) * apart <= (100 - percent) * (a + b))


def greedy_heads(items: DataFrame, percent: int = 60) -> DataFrame:
    """(place, head) for items (place, tokens): the first head among the items before it whose set of words has a Jaccard
    similarity of at least ``percent``, or the item itself if there is none.

    place: a whole number that orders the items, different for each. Empty and null sets resemble nothing.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    given = items.select(F.col("place").cast("long").alias("place"), F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))).alias("tokens"))
    alone = given.where(F.size("tokens") == 0).select("place", F.col("place").alias("head"))
    keyed = given.where(F.size("tokens") > 0).withColumn("same", F.sha2(F.to_json("tokens"), 256))
    classes = keyed.groupBy("same").agg(F.min("place").alias("rep"), F.first("tokens").alias("tokens"))
    sets = saved(_ordered(classes.select(F.col("rep").alias("place"), "tokens"), percent))
    leads = sets.where(F.size("lead") > 0).select("place", "n", "sign", "lead")
    heads = saved(sets.where(F.size("lead") == 0).select("place"))
    taken = sets.select("place", F.col("place").alias("head")).limit(0)
    open_ = leads.select("place")

    def met(of: DataFrame, x: str) -> DataFrame:
        """The leading words of the sets ``of`` (place), with what tells whether two sets may be similar."""
        rows = leads.join(of, "place", "left_semi").select("place", "n", "sign", F.inline("lead"))
        return rows.select("token", *(F.col(c).alias(v) for c, v in (("place", x), ("n", f"{x}_n"), ("i", f"{x}_i"), ("sign", f"{x}_sign"))))

    def joined(new: DataFrame, others: DataFrame) -> DataFrame:
        """(place, head): items of ``others`` after a head of ``new`` that resemble it. Only pairs that may are moved."""
        pairs = met(new, "a").join(met(others, "b"), "token").where((F.col("a") < F.col("b")) & _possible(percent)).select("a", "b").distinct()
        return _similar(pairs, sets, percent).select(F.col("b").alias("place"), F.col("a").alias("head"))

    for _ in range(ROUNDS):
        mine = leads.join(open_, "place", "left_semi").select("place", F.inline("lead"))
        lead = mine.groupBy("token").agg(F.min("place").alias("lead"))
        new = saved(mine.join(lead, "token").groupBy("place").agg(F.min(F.col("lead") == F.col("place")).alias("first")).where("first").select("place"))
        heads = saved(heads.unionByName(new))
        taken = saved(taken.unionByName(joined(new, sets.select("place").join(heads, "place", "left_anti"))).groupBy("place").agg(F.min("head").alias("head")))
        open_ = saved(open_.join(new, "place", "left_anti").join(taken, "place", "left_anti"))
        if open_.isEmpty():
            break
    edges = saved(joined(open_, open_).select(F.col("head").alias("a"), F.col("place").alias("b")))
    late = open_.limit(0)
    while not open_.isEmpty():
        if edges.count() <= SMALL:
            refused = edges.groupBy(F.lit(0).alias("all")).applyInArrow(_in_order, "b long").select(F.col("b").alias("place"))
            late = late.unionByName(open_.join(refused, "place", "left_anti"))
            break
        new = saved(open_.join(edges.select(F.col("b").alias("place")), "place", "left_anti"))
        gone = saved(edges.join(new, edges["a"] == new["place"], "left_semi").select(F.col("b").alias("place")).distinct())
        late = late.unionByName(new)
        open_ = saved(open_.join(new, "place", "left_anti").join(gone, "place", "left_anti"))
        edges = saved(edges.join(open_.withColumnRenamed("place", "a"), "a", "left_semi").join(open_.withColumnRenamed("place", "b"), "b", "left_semi").select("a", "b"))
    late = saved(late)
    heads = heads.unionByName(late)
    taken = taken.unionByName(joined(late, sets.select("place").join(heads, "place", "left_anti"))).groupBy("place").agg(F.min("head").alias("head"))
    decided = saved(heads.select("place", F.col("place").alias("head")).unionByName(taken)).withColumnRenamed("place", "rep")
    return keyed.join(classes.select("same", "rep"), "same").join(decided, "rep").select("place", "head").unionByName(alone)


def _in_order(edges: pa.Table) -> pa.Table:
    """The items that aren't heads among those of ``SMALL`` pairs (a before b): those with a head before them."""
    refused: set[int] = set()
    table = edges.sort_by([("b", "ascending")])
    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
        if b not in refused and a not in refused:  # all that comes before b is settled, as pairs go by b
            refused.add(b)
    return pa.table({"b": pa.array(sorted(refused), pa.int64())})


def clusters(questions: DataFrame, percent: int = 60) -> DataFrame:
    """(head, representative, n, last_asked, examples) of questions (place, text, tokens, at): the longest text stands for
    a cluster (the first of equally long ones), and its three newest questions are shown."""
    placed = questions.join(greedy_heads(questions, percent), "place")
    newest = F.array_sort(F.collect_list(F.struct("at", "place", "text")), lambda a, b: F.when(a["at"] > b["at"], -1).when(a["at"] < b["at"], 1).when(a["place"] < b["place"], -1).otherwise(1))
    few = placed.withColumn("_i", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("at"), "place"))).where("_i <= 3").groupBy("head").agg(F.transform(newest, lambda q: q["text"]).alias("examples"))
    told = placed.groupBy("head").agg(F.max_by("text", F.struct(F.length("text"), -F.col("place"))).alias("representative"), F.count("*").alias("n"), F.max("at").alias("last_asked"))
    return told.join(few, "head")


def without_repeats(questions: DataFrame, percent: int = 60) -> DataFrame:
    """Questions (place, tokens, ...) that resemble none that was kept before them."""
    return questions.join(greedy_heads(questions, percent).where("head = place").select("place"), "place", "left_semi")
