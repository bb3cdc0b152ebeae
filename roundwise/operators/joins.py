"""As-of and window joins between forecasts and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIPE = 4096
#: Ids in a block of one task, and targets that are broadcast.
BLOCK, TARGETS = 65_536, 10_000


def targets_of(locks: DataFrame) -> DataFrame:
    """The locks' distinct targets as _t; broadcast if there are few."""
    found = locks.select(F.col("target").alias("_t")).distinct()
    return F.broadcast(found) if found.limit(TARGETS + 1).count() <= TARGETS else found


def first_hit(locks: DataFrame, rounds: DataFrame, until: Column, after: str = "made", into: str = "hit") -> DataFrame:
    """locks (target, after, ...) with into: the first round_id in (after, until]
    whose multiplier reaches the target; null if there is none.

    A range join by stripes of ids: each lock meets only the hits in the stripes
    that its interval touches, so work follows the intervals' lengths, and the
    equi-join key (target, stripe) spreads them."""
    targets = targets_of(locks)
    hits = rounds.select(F.col("round_id").alias("_hit"), "multiplier").join(targets, F.col("multiplier") >= F.col("_t"))
    hits = hits.select("_t", "_hit", F.floor(F.col("_hit") / STRIPE).alias("_s"))
    spread = locks.select("target", F.col(after).alias("_a"), until.alias("_u")).distinct().where(F.col("_u") > F.col("_a"))
    spread = spread.withColumn("_s", F.explode(F.sequence(F.floor((F.col("_a") + 1) / STRIPE), F.floor(F.col("_u") / STRIPE))))
    met = spread.withColumnRenamed("target", "_lt").join(hits.withColumnRenamed("_s", "_hs"), (F.col("_lt") == F.col("_t")) & (F.col("_s") == F.col("_hs")) & (F.col("_hit") > F.col("_a")) & (F.col("_hit") <= F.col("_u")))
    first = met.groupBy("_lt", "_a", "_u").agg(F.min("_hit").alias(into))
    asked = locks.withColumn("_until", until)
    return asked.join(first, (F.col("target") == F.col("_lt")) & (F.col(after) == F.col("_a")) & (F.col("_until") == F.col("_u")), "left").select(*locks.columns, into)


def next_hit(locks: DataFrame, rounds: DataFrame, after: str = "made", into: str = "hit", block: int = BLOCK) -> DataFrame:
    """As first_hit without an end. Locks and hits of a target are merged in id
    order inside blocks of ids; a lock without a later hit in its block takes the
    first hit of the blocks that follow, of which there is one row a block."""
    hits = rounds.join(targets_of(locks), F.col("multiplier") >= F.col("_t")).select(F.col("_t").alias("target"), F.col("round_id").alias("_at"), F.col("round_id").alias("_hit"))
    asked = locks.select("target", F.col(after).alias("_at")).distinct().withColumn("_hit", F.lit(None).cast("long"))
    both = hits.unionByName(asked).withColumn("_blk", F.floor(F.col("_at") / block).cast("long"))
    inside = Window.partitionBy("target", "_blk").orderBy(F.desc("_at"), F.col("_hit").isNotNull().cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("target").orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy("target", "_blk").agg(F.min("_hit").alias("_first")).select("target", "_blk", F.last("_first", ignorenulls=True).over(later).alias("_later"))
    found = both.withColumn("_near", F.last("_hit", ignorenulls=True).over(inside)).where("_hit IS NULL").join(firsts, ["target", "_blk"])
    found = found.select(F.col("target").alias("_t"), "_at", F.coalesce("_near", "_later").alias(into))
    return locks.join(found, (F.col("target") == F.col("_t")) & (F.col(after) == F.col("_at")), "left").drop("_t", "_at")
