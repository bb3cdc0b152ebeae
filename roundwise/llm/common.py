"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of the word separators \x20 and \x09-\x0D.
SPACES = r"[ \t-\r]+"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what
    the context already has. Only a local session without either gets a
    temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="roundwise-"))
    return context.getCheckpointDir().rstrip("/")


def staging_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application staged: for callers whose results are
    written, since a result that is still lazy reads some of it."""
    _delete(spark, staging_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: this cuts the
    lineage, is computed once, and survives lost executors."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = spark.conf.get(BATCH)
    try:  # small batches for Python workers, for this write only
        spark.conf.set(BATCH, str(min(int(held), 1000) if int(held) > 0 else 1000))
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path  # type: ignore[attr-defined]
    return out


def unstage(df: DataFrame | None) -> None:
    """Deletes what staged() wrote, when nothing reads it any longer."""
    path = getattr(df, "_staged_at", None)
    if path:
        _delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most rows rows and about size bytes, so that what
    Python makes of them stays small. Spark bounds the batches themselves by
    spark.sql.execution.arrow.maxBytesPerBatch, 64 MB if not set otherwise."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def free_name(name: str, docs: DataFrame) -> str:
    """name, lengthened until docs has no such column."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name
