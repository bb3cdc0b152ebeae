"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roundwise.functions.params import BUCKETS, TOKENS


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def token(m: Column) -> Column:
    """Level 0 to 8 of a multiplier."""
    out = F.lit(0)
    for cut in TOKENS:
        out = out + (m >= cut).cast("int")
    return out


def bucket_closed(m: Column) -> Column:
    """Number of the closed bucket; null in the holes between and below 1."""
    out = F.lit(None).cast("int")
    for i, (_, low, high) in reversed(list(enumerate(BUCKETS))):
        out = F.when(m.between(low, high), F.lit(i)).otherwise(out)
    return out


def bucket_half_open(m: Column) -> Column:
    """Number of the bucket [low, next low); null below 1."""
    out = F.lit(None).cast("int")
    for i, (_, low, _) in enumerate(BUCKETS):
        out = F.when(m >= low, F.lit(i)).otherwise(out)
    return out


def outcome(lo: Column, hi: Column, hit: Column) -> Column:
    """win inside the window, early before it, else loss."""
    return F.when(hit.between(lo, hi), "win").when(hit < lo, "early").otherwise("loss")


def wilson(wins: Column, losses: Column, z: float = 1.96) -> tuple[Column, Column]:
    n = F.nullif(wins + losses, F.lit(0))
    p = wins / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
