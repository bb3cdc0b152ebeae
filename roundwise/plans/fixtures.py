"""Tables of the domain derived from the driver's tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundwise.functions.params import SPANS

R = "rounds AS (SELECT event_id AS round_id, round(exp(value / 50.0), 4) AS multiplier, ts, event_type AS source_key, props FROM events)"
LOCKS = (
    "targets(target, span) AS (VALUES " + ", ".join(f"({t}, {s})" for t, s in SPANS.items()) + "), "
    "locks AS (SELECT target, span, round_id AS made, round_id + CAST(floor(target / 2) AS BIGINT) + 1 AS lo, "
    "round_id + CAST(floor(target / 2) AS BIGINT) + span AS hi FROM rounds CROSS JOIN targets WHERE round_id % 100 = 0)"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_id, multiplier, ts, source_key, props."""
    return events(spark, sf_dir).select(F.col("event_id").alias("round_id"), F.round(F.exp(F.col("value") / 50.0), 4).alias("multiplier"), "ts", F.col("event_type").alias("source_key"), "props")


def param(spark: SparkSession, name: str, values) -> DataFrame:
    """A small parameter table, for broadcasts."""
    values = [v if isinstance(v, tuple) else (v,) for v in values]
    return F.broadcast(spark.createDataFrame(values, name))


def locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast a target every 100 rounds: target, span, made, lo, hi."""
    made = rounds(spark, sf_dir).where("round_id % 100 = 0").select(F.col("round_id").alias("made"))
    lo = F.col("made") + F.floor(F.col("target") / 2).cast("long") + 1
    return made.crossJoin(param(spark, "target int, span int", SPANS.items())).withColumn("lo", lo).withColumn("hi", lo + F.col("span") - 1)
