"""Scans: filters, limits, strides, deduplication and small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundwise.catalog import query
from roundwise.functions.expressions import outcome
from roundwise.operators import joins
from roundwise.operators.ordered import indexed
from roundwise.plans.fixtures import LOCKS, R, locks, rounds

#: The ledger: every lock with the first hit after it was made.
LEDGER = LOCKS + ", hits AS (SELECT round_id, multiplier FROM rounds WHERE multiplier >= 5), ledger AS (SELECT l.*, h.hit, CASE WHEN h.hit BETWEEN l.lo AND l.hi THEN 'win' WHEN h.hit < l.lo THEN 'early' ELSE 'loss' END AS outcome FROM locks l LEFT JOIN (SELECT l.target, l.made, min(h.round_id) AS hit FROM locks l JOIN hits h ON h.multiplier >= l.target AND h.round_id > l.made AND h.round_id <= l.hi GROUP BY ALL) h ON h.target = l.target AND h.made = l.made)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, span, made, lo, hi, hit (null: none up to hi), outcome."""
    found = joins.first_hit(locks(spark, sf_dir), rounds(spark, sf_dir), F.col("hi"))
    return found.withColumn("outcome", outcome(F.col("lo"), F.col("hi"), F.col("hit")))


@query(f"WITH {R} SELECT round_id, multiplier, source_key FROM rounds ORDER BY round_id DESC LIMIT 500")
def rounds_latest_n(spark, sf_dir):
    """The newest 500, in ascending order."""
    return rounds(spark, sf_dir).select("round_id", "multiplier", "source_key").orderBy(F.desc("round_id")).limit(500).orderBy("round_id")


@query(f"WITH {R} SELECT round_id, multiplier FROM rounds WHERE round_id > 900")
def rounds_since(spark, sf_dir):
    return rounds(spark, sf_dir).where("round_id > 900").select("round_id", "multiplier")


@query(f"WITH {R} SELECT round_id, multiplier FROM rounds WHERE round_id <= 500")
def prefix_slice(spark, sf_dir):
    return rounds(spark, sf_dir).where("round_id <= 500").select("round_id", "multiplier")


@query(f"WITH {R}, i AS (SELECT row_number() OVER (ORDER BY round_id) - 1 AS idx, round_id, multiplier FROM rounds), s AS (SELECT CAST(ceil(count(*) / 500.0) AS BIGINT) AS stride FROM rounds) SELECT idx, round_id, multiplier FROM i, s WHERE idx % stride = 0")
def rounds_stride(spark, sf_dir):
    """Every ceil(n / 500)-th row."""
    r = rounds(spark, sf_dir).select("round_id", "multiplier")
    stride = r.agg(F.ceil(F.count(F.lit(1)) / 500).alias("stride"))
    return indexed(r).crossJoin(F.broadcast(stride)).where("idx % stride = 0").select("idx", "round_id", "multiplier")


@query(f"WITH {R}, i AS (SELECT row_number() OVER (ORDER BY round_id DESC) AS back, round_id, multiplier FROM rounds) SELECT CASE WHEN back <= 24 THEN 'recent' ELSE 'previous' END AS slice, round_id, multiplier FROM i WHERE back <= 48")
def tail_slices(spark, sf_dir):
    """The last 24 rows and the 24 before them."""
    last = rounds(spark, sf_dir).select("round_id", "multiplier").orderBy(F.desc("round_id")).limit(48)
    back = F.row_number().over(Window.orderBy(F.desc("round_id")))  # 48 rows
    return last.select(F.when(back <= 24, "recent").otherwise("previous").alias("slice"), "round_id", "multiplier")


BATCHES = f"{R}, batches AS (SELECT round_id, multiplier, 1 AS arrival FROM rounds WHERE round_id % 3 <> 0 UNION ALL SELECT round_id, CASE WHEN round_id % 3 <> 0 THEN multiplier + 1 ELSE multiplier END, 2 FROM rounds)"


def batches(spark, sf_dir) -> DataFrame:
    """Two deliveries: the second sends all rounds, re-sent ones changed."""
    r = rounds(spark, sf_dir).select("round_id", "multiplier")
    first = r.where("round_id % 3 <> 0").withColumn("arrival", F.lit(1))
    again = r.select("round_id", F.when(F.col("round_id") % 3 != 0, F.col("multiplier") + 1).otherwise(F.col("multiplier")).alias("multiplier"), F.lit(2).alias("arrival"))
    return first.unionByName(again)


@query(f"WITH {BATCHES} SELECT round_id, arg_max(multiplier, arrival) AS multiplier FROM batches WHERE multiplier >= 1 GROUP BY round_id")
def rounds_dedup(spark, sf_dir):
    """Valid rows, the last arrival of each id."""
    return batches(spark, sf_dir).where("multiplier >= 1").groupBy("round_id").agg(F.max_by("multiplier", "arrival").alias("multiplier"))


@query(f"WITH {R}, {LEDGER} SELECT target, made, lo, hi, hit, outcome FROM ledger ORDER BY greatest(coalesce(hi, 0), coalesce(hit, 0)) DESC, hi DESC, made DESC, target DESC LIMIT 200")
def ledger_ordered(spark, sf_dir):
    last = F.greatest(F.coalesce("hi", F.lit(0)), F.coalesce("hit", F.lit(0)))
    return ledger(spark, sf_dir).select("target", "made", "lo", "hi", "hit", "outcome").orderBy(last.desc(), F.desc("hi"), F.desc("made"), F.desc("target")).limit(200)


@query(f"WITH {R}, {LEDGER} SELECT concat(target, 'x') AS label, made, outcome FROM ledger WHERE lower(concat(target, 'X')) = '20x'")
def ledger_filter(spark, sf_dir):
    """History of one target by its label, in either case."""
    named = ledger(spark, sf_dir).withColumn("label", F.concat("target", F.lit("x")))
    return named.where(F.lower("label") == "20x").select("label", "made", "outcome")


@query(f"WITH {R} SELECT source_key, round_id, multiplier FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY round_id DESC) AS rn FROM rounds) WHERE rn <= 20")
def source_rounds_top_n(spark, sf_dir):
    """The newest 20 of each source. rank limits prune before the shuffle."""
    newest = F.row_number().over(Window.partitionBy("source_key").orderBy(F.desc("round_id")))
    return rounds(spark, sf_dir).withColumn("rn", newest).where("rn <= 20").select("source_key", "round_id", "multiplier")


@query(f"WITH {R} SELECT source_key, round_id, multiplier FROM (SELECT *, row_number() OVER (ORDER BY round_id DESC) AS rn FROM rounds WHERE source_key = 'click' AND round_id > 100) WHERE rn <= 50")
def source_history(spark, sf_dir):
    picked = rounds(spark, sf_dir).where("source_key = 'click' AND round_id > 100")
    return picked.select("source_key", "round_id", "multiplier").orderBy(F.desc("round_id")).limit(50)


SITES = f"{R}, sites AS (SELECT source_key, count(*) AS n, max(round_id) AS last_round_id, source_key <> 'signup' AS enabled, CASE WHEN source_key = 'error' THEN 'timeout' END AS last_error, concat('https://', source_key, '.example.com/crash') AS game_url FROM rounds GROUP BY source_key)"


def sites(spark, sf_dir) -> DataFrame:
    grouped = rounds(spark, sf_dir).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.max("round_id").alias("last_round_id"))
    key = F.col("source_key")
    return grouped.select("*", (key != "signup").alias("enabled"), F.when(key == "error", "timeout").alias("last_error"), F.concat(F.lit("https://"), key, F.lit(".example.com/crash")).alias("game_url"))


@query(f"WITH {SITES} SELECT source_key, enabled, last_round_id, row_number() OVER (ORDER BY enabled DESC, last_round_id DESC) AS place FROM sites")
def registry_sorted(spark, sf_dir):
    """Sources, enabled ones first, then the most recent: a small dimension."""
    place = F.row_number().over(Window.orderBy(F.desc("enabled"), F.desc("last_round_id")))
    return sites(spark, sf_dir).select("source_key", "enabled", "last_round_id", place.alias("place"))


@query(f"WITH {R} SELECT max(round_id) AS latest, count(*) AS n FROM rounds")
def latest_and_count(spark, sf_dir):
    return rounds(spark, sf_dir).agg(F.max("round_id").alias("latest"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, n, qty FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) ORDER BY qty DESC, l_orderkey LIMIT 100")
def top_orders(spark, sf_dir):
    """Generic top-k after a grouped sum."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity")
    return line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")).orderBy(F.desc("qty"), "l_orderkey").limit(100)
