"""Streaming queries over the events table; each equals its batch result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundwise.catalog import query
from roundwise.plans.fixtures import R
from roundwise.sources.merges import Appended
from roundwise.streaming import upserts


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir or the context's checkpoint folder; a
    temporary one only in local mode without either."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="roundwise-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream of rounds."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return raw.select(F.col("event_id").alias("round_id"), F.round(F.exp(F.col("value") / 50.0), 4).alias("multiplier"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source_key"))


@query(f"WITH {R} SELECT source_key, count(*) AS n, max(round_id) AS latest, round(sum(multiplier), 4) AS total FROM rounds GROUP BY source_key")
def stream_rounds_upsert(spark, sf_dir):
    """The stream twice over, inserted once."""
    path = work_dir(spark)
    table = Appended(spark, f"{path}/rounds")
    for turn in ("first", "again"):
        upserts.upsert_rounds(event_stream(spark, sf_dir), table, f"{path}/{turn}").awaitTermination()
    return table.read().groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.max("round_id").alias("latest"), F.round(F.sum("multiplier"), 4).alias("total"))


@query(f"WITH {R}, w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, source_key, multiplier FROM rounds) SELECT source_key, count(DISTINCT start) AS windows, count(*) AS n FROM w GROUP BY source_key")
def windowed_rates_batch(spark, sf_dir):
    """The windows of the streaming query, over the whole table."""
    from roundwise.plans.fixtures import rounds

    r = rounds(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    w = upserts.windowed_rates(r)
    return w.groupBy("source_key").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"))


@query()
def stream_windowed_rates(spark, sf_dir):
    """Windows that the watermark has closed."""
    return upserts.run_now(spark, upserts.windowed_rates(event_stream(spark, sf_dir)), work_dir(spark))


@query()
def stream_lock_machine(spark, sf_dir):
    """Locks of three targets, resolved and made anew as rounds come in."""
    stream = event_stream(spark, sf_dir).select("round_id", "multiplier", F.explode(F.array(*map(F.lit, (5, 10, 50)))).alias("target"))
    held = spark.conf.get(PROVIDER)
    try:  # the stream takes the setting when it starts, and is over when run_now is
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        return upserts.run_now(spark, upserts.lock_machine(stream, {5: 3, 10: 6, 50: 17}), work_dir(spark))
    finally:
        spark.conf.set(PROVIDER, held)
