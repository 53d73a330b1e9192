"""Mixing sources to target weights by Sainte-Laguë apportionment.

The target of a source is its weight's share of all words, at most ``most`` times what it has. The words to take
are cut into equal blocks; blocks go to sources by the highest quotients target / (2 k + 1), and each source's
blocks to its shards (hash buckets of its documents, of bounded size) by shard words / (2 k + 1). Within a shard
documents lie in seeded hash order and the quota takes whole passes over it and then its first blocks.

Only DataFrame functions are used. A divisor method needs no step-by-step award: all seats below a divisor that
surely awards too few are given at once, and the few that are left are ranked by their quotients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import _common

#: Words of a block.
BLOCK = 16
#: Words of a shard, about.
SHARD = 1 << 20
#: A source gives at most so many times its words.
MOST = 3
SEED = 20_240


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with weight, place and target. One row a source, so one task orders them.

    Sources are filled in the order of what they can take per weight; one whose limit is below its share of what
    is left gets its limit, and the rest share by weight.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    placed = sources.withColumn("place", F.row_number().over(order) - 1)
    cycle = F.array(*map(F.lit, map(float, weights)))
    placed = placed.withColumn("weight", F.get(cycle, F.pmod("place", F.lit(len(weights)))))
    limit = most * F.col("source_size")
    by = Window.orderBy(limit / F.col("weight"), "place")
    all_rows = Window.partitionBy(F.lit(1))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    share = left / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    capped = placed.withColumn("share", share).withColumn("full", limit <= F.col("share") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(limit / F.col("weight"), F.col("place"), F.col("share")))).over(all_rows)
    return capped.select("source", "source_size", "place", "weight", F.when(F.col("full"), limit.cast("double")).otherwise(F.col("weight") * level["share"]).alias("target"))


def apportion(votes: DataFrame, seats: str, vote: str, tie: str, within: list[str]) -> DataFrame:
    """``votes`` with ``quota``: the Sainte-Laguë award of ``seats`` to the rows of each group ``within``.

    The award for a divisor d is floor(vote / d + 1/2). With n rows and V votes it gives at most S seats for
    d = V / (S - n/2) and at least S for d = V / (S + n/2); between them lie at most 2 n quotients, which are ranked.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    v, s = F.col(vote).cast("double"), F.col(seats).cast("double")
    total, n = F.sum(v).over(group), F.count("*").over(group)
    # an ulp of slack, so that rounding can't award too many at first
    low = F.when((total > 0) & (s > n / 2), F.greatest(F.lit(0), F.floor(v / total * (s - n / 2) * (1 - 1e-12) + 0.5))).otherwise(0).cast("long")
    high = F.when(total > 0, F.floor(v / total * (s + n / 2) * (1 + 1e-12) + 0.5)).otherwise(0).cast("long")
    sized = votes.withColumn("low", low).withColumn("high", F.greatest(high, F.col("low")))
    sized = sized.withColumn("left", F.col(seats) - F.sum("low").over(group))
    near = sized.where("high > low").select(*within, tie, "low", "left", F.col(vote).alias("_v"), F.explode(F.expr("sequence(low, high - 1)")).alias("k"))
    rank = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    won = near.withColumn("rank", F.row_number().over(rank.orderBy(F.desc(F.col("_v") / (2 * F.col("k") + 1)), tie))).where("rank <= left").groupBy(*within, tie).agg(F.count("*").alias("more"))
    on = F.lit(True)
    won = won.select(*(F.col(c).alias(f"_{c}") for c in [*within, tie]), "more")
    for c in [*within, tie]:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return sized.join(won, on, "left").withColumn("quota", F.col("low") + F.coalesce("more", F.lit(0))).drop("low", "high", "left", "more", *(f"_{c}" for c in [*within, tie]))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), key: str = "doc_id", source: str = "source", text: str = "text", most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(key, size, source_size, target, taken) for each row of ``docs``.

    Sources in code point order, null last (a source of its own), have the weights in turn. Null and empty texts
    have size 0 and give nothing; rows repeated with all their columns are separate and lie side by side; ties of
    quotients go to the earlier source or shard. The same table gives the same result in any run. Other columns are
    ignored; an empty table gives an empty result.
    """
    sized = _common.materialize(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = targets(sources, weights, most)
    everything = Window.partitionBy(F.lit(1))
    blocks = aimed.withColumn("blocks", F.floor(F.sum("target").over(everything) / block + 0.5).cast("long"))
    quotas = apportion(blocks, "blocks", "target", "place", []).withColumnRenamed("quota", "source_quota")
    quotas = _common.materialize(quotas.select("source", "place", "source_size", "target", "source_quota", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long").alias("n_shards")), "quotas")

    q = quotas.withColumnRenamed("source", "_source")
    rows = sized.join(q, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    rows = rows.withColumn("order", F.xxhash64(F.col("key"), F.lit(seed))).withColumn("shard", F.pmod("order", "n_shards"))
    shards = rows.groupBy("place", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    awarded = apportion(shards, "source_quota", "shard_size", "shard", ["place"]).select(F.col("place").alias("_place"), F.col("shard").alias("_shard"), "shard_size", "quota")
    rows = rows.join(awarded, (F.col("place") == F.col("_place")) & (F.col("shard") == F.col("_shard")))
    until = Window.partitionBy("place", "shard").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(until)
    words = F.least(F.col("quota") * block, most * F.col("shard_size"))
    passes = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0)
    rest = words - passes * F.col("shard_size")
    rows = rows.withColumn("end", end).withColumn("passes", passes.cast("long")).withColumn("rest", rest.cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("end") - F.col("size"))))
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
