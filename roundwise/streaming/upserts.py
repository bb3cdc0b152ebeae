"""Streams: checkpointed upserts, a lock machine and windowed rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from roundwise.sources.merges import Appended


def upsert_rounds(stream: DataFrame, table: Appended, checkpoint: str, trigger: dict | None = None):
    """Appends rounds whose id is new, one micro-batch after the other. A batch
    that is delivered again changes nothing, so restarts are safe."""
    return stream.writeStream.foreachBatch(lambda batch, _: table.add(batch, "ts")).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Locks(StatefulProcessor):
    """State of a target: one lock (made, lo, hi, generation). A hit inside the
    window wins, one before is early; a round past hi loses; each resolution
    makes the next generation."""

    def __init__(self, spans: dict[int, int]):
        self.spans = spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lock = handle.getValueState("lock", "made long, lo long, hi long, generation int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        target, out = int(key[0]), []
        span = self.spans[target]
        frame = pd.concat(list(rows)).sort_values("round_id")
        held = self.lock.get() if self.lock.exists() else None
        for row in frame.itertuples():
            at, hit = int(row.round_id), row.multiplier >= target
            if held is not None:
                made, lo, hi, generation = held
                outcome = ("early" if at < lo else "win") if hit and at <= hi else "loss" if at >= hi else None
                if outcome:
                    out.append((target, generation, made, lo, hi, at if outcome != "loss" else None, outcome))
                    held = None if outcome is None else (at, at + target // 2 + 1, at + target // 2 + span, generation + 1)
            else:
                held = (at, at + target // 2 + 1, at + target // 2 + span, 1)
        if held is not None:
            self.lock.update(held)
        result = pd.DataFrame(out, columns=["target", "generation", "made", "lo", "hi", "hit", "outcome"])
        result["hit"] = result.hit.astype("Int64")
        yield result

    def close(self) -> None:
        pass


SCHEMA = "target int, generation int, made long, lo long, hi long, hit long, outcome string"


def lock_machine(stream: DataFrame, spans: dict[int, int]) -> DataFrame:
    """stream: target, round_id, multiplier."""
    return stream.groupBy("target").transformWithStateInPandas(statefulProcessor=Locks(spans), outputStructType=SCHEMA, outputMode="append", timeMode="None")


def windowed_rates(rows: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Tumbling event-time windows of a source: rounds and the rate at 10 or more.
    An extension: the feeds know no watermark but the highest id."""
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "source_key")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("multiplier") >= 10).cast("double")).alias("rate")).select(F.col("window.start").alias("start"), "source_key", "n", "rate")


def run_now(spark: SparkSession, df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, to Parquet, and reads the result."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")
