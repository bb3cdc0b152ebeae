"""Cumulative weights over sorted values, and the quantiles they give, without one
task that holds or sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of values; each is sorted in a task of its own.
BLOCKS = 256


def cumulative(df: DataFrame, by: tuple[str, ...], value: str, weight: Column | None = None, blocks: int = BLOCKS) -> DataFrame:
    """by, value, w, upto, whole of each distinct value: its weight, that of all
    values up to it, and that of the group. Bounds of the blocks are approximate
    quantiles over all groups; they decide the cost, never the result."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("w"))
    bounds = df.agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 4 * blocks)).first()[0] or []
    bounds = sorted(set(bounds))
    block = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(value))) if bounds else F.lit(0)
    sums = sums.withColumn("_blk", block)
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*by)
    outer = sums.groupBy(*by, "_blk").agg(F.sum("w").alias("_s")).select(*by, "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_from"), F.sum("_s").over(all_).alias("whole"))
    inner = F.sum("w").over(Window.partitionBy(*by, "_blk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = sums.withColumn("_near", inner).join(outer, [*by, "_blk"])
    return found.select(*by, value, "w", (F.col("_near") + F.col("_from")).alias("upto"), "whole")


def interpolated(df: DataFrame, by: tuple[str, ...], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name, the exact quantile interpolated at (n - 1) * share."""
    c = cumulative(df, by, value)
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("w") <= rank)
    ends = []
    for name, q in shares.items():
        at = q * (F.col("whole") - 1)
        ends += [F.max(F.when(holds(F.floor(at)), F.col(value))).alias(f"_low_{name}"), F.max(F.when(holds(F.ceil(at)), F.col(value))).alias(f"_high_{name}"), F.max(at).alias(f"_at_{name}")]
    found = c.groupBy(*by).agg(*ends)

    def between(name: str) -> Column:
        low, high, at = F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col(f"_at_{name}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return found.select(*by, *[between(n) for n in shares])


def first_reaching(df: DataFrame, by: tuple[str, ...], value: str, weight: Column, shares: dict[str, float]) -> DataFrame:
    """by and, for each name, the first value whose cumulative share of the weights
    reaches the share; and mean, weighted."""
    c = cumulative(df, by, value, weight)
    at = lambda q: F.min(F.when(F.col("upto") / F.col("whole") >= q, F.col(value)))
    return c.groupBy(*by).agg(*[at(q).alias(n) for n, q in shares.items()], (F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"))
