"""Upserts as set operations, and tables that are replaced whole or in part."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundwise.functions.expressions import outcome


def insert_ignore(stored: DataFrame, fresh: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """stored and the first arrival of each key that it lacks."""
    columns = [c for c in fresh.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*columns), arrival).alias("_x")).select(*keys, "_x.*")
    return stored.unionByName(first.join(stored, keys, "left_anti").select(*stored.columns))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The last arrival of each key, stored rows being the earliest."""
    columns = [c for c in stored.columns if c not in keys]
    every = stored.withColumn("_at", F.lit(0).cast("long")).unionByName(fresh.withColumn("_at", F.col(arrival).cast("long") + 1).select(*stored.columns, "_at"))
    return every.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_at").alias("_x")).select(*keys, "_x.*").select(*stored.columns)


def merge_forecasts(stored: DataFrame, fresh: DataFrame, kept: tuple[str, ...] = (), arrival: str | None = None) -> DataFrame:
    """target, lo, hi, hit, generation and the columns of kept: windows that end
    before they begin are dropped; equal windows merge. Of kept, the last value by
    arrival that is not null stays (stored ones are the earliest)."""
    names = ["target", "lo", "hi", "hit", "generation", *kept]
    one = lambda df, at: df.select(*names, at.alias("_at"))
    every = one(stored, F.lit(-1).cast("long")).unionByName(one(fresh, F.col(arrival).cast("long") if arrival else F.lit(0).cast("long"))).where("hi >= lo")
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in kept]
    merged = every.groupBy("target", "lo", "hi").agg(F.min("hit").alias("hit"), F.max("generation").alias("generation"), *last)
    return merged.withColumn("outcome", outcome(F.col("lo"), F.col("hi"), F.col("hit")))


def patch(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """changes: keys, a column for each that may change, and has_<column>, which
    tells a change to null from no change."""
    named = [c for c in changes.columns if f"has_{c}" in changes.columns]
    new = changes.select(*keys, *[F.struct(F.col(f"has_{c}").alias("on"), F.col(c).alias("to")).alias(f"_{c}") for c in named])
    joined = stored.join(new, keys, "left")
    return joined.select(*[F.when(F.col(f"_{c}.on"), F.col(f"_{c}.to")).otherwise(F.col(c)).alias(c) if c in named else F.col(c) for c in stored.columns])


class Conflict(RuntimeError):
    """Somebody else committed the version that a writer was about to commit."""


class Table:
    """A Parquet table of versions. A version is written beside the last one and
    committed by creating a file with its number, which fails if there is one: so
    readers see a whole version, a crash before the commit changes nothing, and of
    two writers one gets a Conflict. Old versions stay until vacuum."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def commits(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return []
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit() and x.getLen() > 0)

    def version(self) -> str | None:
        """The folder of the last committed version."""
        found = self.commits()
        return self._folder(found[-1]) if found else None

    def _folder(self, number: int) -> str:
        return self.spark.read.text(f"{self.path}/commits/{number:012d}").first()[0]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version()}")

    def replace(self, df: DataFrame, partition_by: list[str] | None = None) -> None:
        number = (self.commits() or [0])[-1] + 1
        name = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*(partition_by or [])).parquet(f"{self.path}/{name}")
        fs, at = self._fs(f"{self.path}/commits/{number:012d}")
        if fs.exists(at) and fs.getFileStatus(at).getLen() == 0:
            fs.delete(at, False)  # of a writer that died between two steps
        try:
            out = fs.create(at, False)
        except Exception as e:
            fs.delete(self._fs(f"{self.path}/{name}")[1], True)
            raise Conflict(f"version {number} of {self.path} is there already") from e
        out.write(bytearray(name.encode()))
        out.close()

    def delete(self, condition) -> int:
        """Rows that go, counted before they do."""
        rows = self.read()
        gone = rows.where(condition).count()
        self.replace(rows.where(~F.coalesce(condition, F.lit(False))))
        return gone

    def replace_where(self, column: str, value, df: DataFrame) -> None:
        """Rows whose column has the value go, and those of df come in their place."""
        if self.version() is None:
            self.replace(df)
        else:
            self.replace(self.read().where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(df))

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last keep versions; how many went."""
        old = self.commits()[:-keep]
        for number in old:
            folder = self._folder(number)
            for path in (f"{self.path}/commits/{number:012d}", f"{self.path}/{folder}"):
                fs, at = self._fs(path)
                fs.delete(at, True)
        return len(old)


class Appended:
    """A Parquet table of rows that are only ever added, in partitions of ids. A
    batch reads the partitions that it touches and writes its new rows."""

    def __init__(self, spark: SparkSession, path: str, key: str = "round_id", block: int = 65_536):
        self.spark, self.path, self.key, self.block = spark, path.rstrip("/"), key, block

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("block")

    def add(self, batch: DataFrame, arrival: str) -> None:
        """Adds the first arrival of each key that is not there yet. A batch that is
        delivered again, or half written before, adds only what lacks."""
        others = [c for c in batch.columns if c != self.key]
        fresh = batch.groupBy(self.key).agg(F.min_by(F.struct(*others), arrival).alias("_x")).select(self.key, "_x.*")
        fresh = fresh.withColumn("block", F.floor(F.col(self.key) / self.block).cast("long"))
        if self.exists():
            touched = [r[0] for r in fresh.select("block").distinct().collect()]
            stored = self.spark.read.parquet(self.path).where(F.col("block").isin(touched)).select(self.key)
            fresh = fresh.join(stored, self.key, "left_anti").select(*fresh.columns)
        fresh.write.mode("append").partitionBy("block").parquet(self.path)


def delete_cascade(parent: Table, key: str, value, children: dict[Table, str]) -> dict[str, int]:
    """Deletes the parent's rows of a key, and the children's rows that point to
    them; how many went, by path. A key is required."""
    if value is None:
        raise ValueError(f"{key} is required")
    gone = {child.path: child.delete(F.col(column) == value) for child, column in children.items()}
    return gone | {parent.path: parent.delete(F.col(key) == value)}
