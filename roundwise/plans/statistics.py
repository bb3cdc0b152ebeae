"""Descriptive statistics of rounds and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roundwise.catalog import query
from roundwise.functions.expressions import bucket_closed, bucket_half_open, wilson
from roundwise.functions.params import BUCKETS, DROUGHTS
from roundwise.operators import quantiles
from roundwise.plans.fixtures import R, param, rounds
from roundwise.plans.scans import LEDGER, SITES, ledger, sites


def values(items) -> str:
    return ", ".join(f"({x})" for x in items)


@query(f"WITH {R} SELECT count(*) AS total, min(round_id) AS oldest, max(round_id) AS newest, round(avg(multiplier), 6) AS avg_multiplier, max(multiplier) AS max_multiplier, min(multiplier) AS min_multiplier, min(ts) AS oldest_date, max(ts) AS newest_date FROM rounds")
def storage_stats(spark, sf_dir):
    return rounds(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.min("round_id").alias("oldest"), F.max("round_id").alias("newest"), F.round(F.avg("multiplier"), 6).alias("avg_multiplier"), F.max("multiplier").alias("max_multiplier"), F.min("multiplier").alias("min_multiplier"), F.min("ts").alias("oldest_date"), F.max("ts").alias("newest_date"))


BINS = (("lt2", 0, 2), ("b2_5", 2, 5), ("b5_10", 5, 10), ("b10_20", 10, 20), ("b20_50", 20, 50), ("b50_100", 50, 100), ("gte100", 100, 1e18))


@query(f"WITH {R} SELECT " + ", ".join(f"count(*) FILTER (WHERE multiplier >= {a} AND multiplier < {b}) AS {n}" for n, a, b in BINS) + " FROM rounds")
def distribution_bins(spark, sf_dir):
    m = F.col("multiplier")
    return rounds(spark, sf_dir).agg(*[F.count_if((m >= a) & (m < b)).alias(n) for n, a, b in BINS])


@query(f"WITH {R}, t(target) AS (VALUES {values(DROUGHTS)}) SELECT target, (SELECT max(round_id) FROM rounds) - max(CASE WHEN multiplier >= target THEN round_id END) AS gap FROM t CROSS JOIN rounds GROUP BY target")
def threshold_gaps(spark, sf_dir):
    """Rounds since the last hit of each threshold; null if there was none. One
    pass with a conditional maximum for each threshold, stacked afterwards."""
    m, r = F.col("multiplier"), F.col("round_id")
    one = rounds(spark, sf_dir).agg(F.max(r).alias("latest"), *[F.max(F.when(m >= t, r)).alias(f"h{t}") for t in DROUGHTS])
    rows = F.array(*[F.struct(F.lit(t).alias("target"), (F.col("latest") - F.col(f"h{t}")).alias("gap")) for t in DROUGHTS])
    return one.select(F.explode(rows).alias("x")).select("x.*")


SUMMARY = "count(*) AS total, max(round_id) AS latest, max(multiplier) AS highest, round(avg(multiplier), 6) AS avg_multiplier, count(*) FILTER (WHERE multiplier >= 3) AS gte3, count(*) FILTER (WHERE multiplier >= 4) AS gte4, count(*) FILTER (WHERE multiplier >= 5) AS gte5"


@query(f"WITH {R} SELECT source_key, {SUMMARY} FROM rounds GROUP BY source_key")
def source_summary(spark, sf_dir):
    m = F.col("multiplier")
    return rounds(spark, sf_dir).groupBy("source_key").agg(F.count(F.lit(1)).alias("total"), F.max("round_id").alias("latest"), F.max(m).alias("highest"), F.round(F.avg(m), 6).alias("avg_multiplier"), *[F.count_if(m >= k).alias(f"gte{k}") for k in (3, 4, 5)])


@query(f"WITH {SITES}, a AS (SELECT source_key, avg(multiplier) AS mean FROM rounds GROUP BY source_key), s AS (SELECT sites.*, mean, CASE WHEN NOT enabled THEN 'disabled' WHEN last_error IS NOT NULL THEN 'error' WHEN n > 0 THEN 'live' ELSE 'idle' END AS health, CASE WHEN n > 0 THEN 4 ELSE 0 END + CASE WHEN last_error IS NULL THEN 1 ELSE 0 END + last_round_id / 1e6 AS priority, CASE WHEN source_key IN ('view', 'click') THEN 'shared' ELSE source_key END AS url_key FROM sites JOIN a USING (source_key)), d AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY priority DESC, source_key) AS rn FROM s) SELECT count(*) AS sites, count(*) FILTER (WHERE health = 'live') AS live, CAST(sum(n) AS BIGINT) AS total, round(sum(mean * n) / sum(n), 6) AS avg_multiplier FROM d WHERE rn = 1")
def dashboard_rollup(spark, sf_dir):
    """Sources deduplicated by their URL key with a priority, then a weighted
    average over those that stay."""
    means = rounds(spark, sf_dir).groupBy("source_key").agg(F.avg("multiplier").alias("mean"))
    s = sites(spark, sf_dir).join(means, "source_key")
    health = F.when(~F.col("enabled"), "disabled").when(F.col("last_error").isNotNull(), "error").when(F.col("n") > 0, "live").otherwise("idle")
    priority = F.when(F.col("n") > 0, 4).otherwise(0) + F.when(F.col("last_error").isNull(), 1).otherwise(0) + F.col("last_round_id") / 1e6
    key = F.when(F.col("source_key").isin("view", "click"), "shared").otherwise(F.col("source_key"))
    s = s.select("*", health.alias("health"), priority.alias("priority"), key.alias("url_key"))
    best = s.groupBy("url_key").agg(F.max_by(F.struct("n", "mean", "health"), F.struct("priority", F.expr("transform(split(source_key, ''), c -> -ascii(c))"))).alias("x")).select("x.*")
    return best.agg(F.count(F.lit(1)).alias("sites"), F.count_if(F.col("health") == "live").alias("live"), F.sum("n").alias("total"), F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 6).alias("avg_multiplier"))


def bucket_probs(spark, sf_dir, bucket):
    names = param(spark, "bucket int, name string", [(i, b[0]) for i, b in enumerate(BUCKETS)])
    counts = rounds(spark, sf_dir).groupBy(bucket(F.col("multiplier")).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    known = names.join(counts, "bucket", "left").crossJoin(F.broadcast(total))
    return known.select("name", F.coalesce("c", F.lit(0)).alias("n"), F.round(F.coalesce("c", F.lit(0)) / F.col("total"), 6).alias("probability"))


NAMES = "b(bucket, name, low, high) AS (VALUES " + ", ".join(f"({i}, '{n}', {a}::DOUBLE, {b if b < 1e300 else 1e18}::DOUBLE)" for i, (n, a, b) in enumerate(BUCKETS)) + ")"


@query(f"WITH {R}, {NAMES} SELECT name, count(round_id) AS n, round(count(round_id) / (SELECT count(*) FROM rounds)::DOUBLE, 6) AS probability FROM b LEFT JOIN rounds ON multiplier BETWEEN low AND high GROUP BY name")
def bucket_probs_closed(spark, sf_dir):
    """Closed buckets: what falls into the holes is in none."""
    return bucket_probs(spark, sf_dir, bucket_closed)


@query(f"WITH {R}, {NAMES} SELECT name, count(round_id) AS n, round(count(round_id) / (SELECT count(*) FROM rounds)::DOUBLE, 6) AS probability FROM (SELECT *, lead(low, 1, 1e18::DOUBLE) OVER (ORDER BY low) AS next FROM b) LEFT JOIN rounds ON multiplier >= low AND multiplier < next GROUP BY name")
def bucket_probs_half_open(spark, sf_dir):
    return bucket_probs(spark, sf_dir, bucket_half_open)


@query(f"WITH {R}, n AS (SELECT count(*) AS n, max(round_id) AS top FROM rounds), k AS (SELECT least(800, greatest(100, CAST(floor(n / 4) AS BIGINT))) AS k FROM n), l AS (SELECT *, row_number() OVER (ORDER BY round_id DESC) AS back FROM rounds), t(target) AS (VALUES (2), (3), (5), (10), (20), (50), (100)) SELECT target, round(avg(CASE WHEN back <= k THEN CASE WHEN multiplier >= target THEN 1.0 ELSE 0.0 END END), 9) AS recent, round(avg(CASE WHEN multiplier >= target THEN 1.0 ELSE 0.0 END), 9) AS rate, round(1.0 / target, 9) AS fair, round(avg(CASE WHEN back <= k THEN CASE WHEN multiplier >= target THEN 1.0 ELSE 0.0 END END) * target - 1, 9) AS ev FROM l, k, t GROUP BY target")
def threshold_snapshot(spark, sf_dir):
    """Recent and overall hit rates beside the fair 1 / target, and the expected
    value at the recent rate."""
    r = rounds(spark, sf_dir).select("round_id", "multiplier")
    size = r.agg(F.count(F.lit(1)).alias("n")).select(F.least(F.lit(800), F.greatest(F.lit(100), F.floor(F.col("n") / 4))).alias("k"))
    tail = r.orderBy(F.desc("round_id")).limit(800)
    back = F.row_number().over(Window.orderBy(F.desc("round_id")))  # 800 rows
    tail = tail.withColumn("back", back).crossJoin(F.broadcast(size)).where("back <= k")
    targets = (2, 3, 5, 10, 20, 50, 100)
    hit = lambda t: (F.col("multiplier") >= t).cast("double")
    recent = tail.agg(*[F.avg(hit(t)).alias(f"p{t}") for t in targets])
    whole = r.agg(*[F.avg(hit(t)).alias(f"q{t}") for t in targets])
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.round(F.col(f"p{t}"), 9).alias("recent"), F.round(F.col(f"q{t}"), 9).alias("rate"), F.round(F.lit(1.0 / t), 9).alias("fair"), F.round(F.col(f"p{t}") * t - 1, 9).alias("ev")) for t in targets])
    return whole.crossJoin(F.broadcast(recent)).select(F.explode(rows).alias("x")).select("x.*")


@query(f"WITH {R} SELECT source_key, quantile_cont(multiplier, 0.25) AS q25, quantile_cont(multiplier, 0.5) AS q50, quantile_cont(multiplier, 0.75) AS q75, quantile_cont(multiplier, 0.9) AS q90 FROM rounds GROUP BY source_key")
def quantile_summary(spark, sf_dir):
    """Exact interpolated quantiles at (n - 1) q."""
    return quantiles.interpolated(rounds(spark, sf_dir), ("source_key",), "multiplier", {f"q{n}": n / 100 for n in (25, 50, 75, 90)})


@query(f"WITH {R}, w AS (SELECT source_key, multiplier, 1 + round_id % 7 AS w FROM rounds), v AS (SELECT source_key, multiplier, sum(w) AS w FROM w GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY source_key ORDER BY multiplier) / sum(w) OVER (PARTITION BY source_key) AS share FROM v) SELECT source_key, min(multiplier) FILTER (WHERE share >= 0.5) AS q50, min(multiplier) FILTER (WHERE share >= 0.9) AS q90, round(sum(multiplier * w) / sum(w), 6) AS mean FROM c GROUP BY source_key")
def weighted_quantile(spark, sf_dir):
    """First value whose cumulative share of weights reaches q."""
    found = quantiles.first_reaching(rounds(spark, sf_dir), ("source_key",), "multiplier", 1 + F.col("round_id") % 7, {"q50": 0.5, "q90": 0.9})
    return found.withColumn("mean", F.round("mean", 6))


@query(f"WITH {R}, {LEDGER}, c AS (SELECT target, count(*) FILTER (WHERE outcome = 'win') AS w, count(*) FILTER (WHERE outcome = 'loss') AS l FROM ledger GROUP BY target), p AS (SELECT *, w + l AS n, w / nullif(w + l, 0)::DOUBLE AS p, 1.96 AS z FROM c) SELECT target, w AS wins, l AS losses, round(greatest(0.0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 9) AS low, round(least(1.0, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 9) AS high FROM p")
def wilson_bounds(spark, sf_dir):
    c = ledger(spark, sf_dir).groupBy("target").agg(F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses"))
    low, high = wilson(F.col("wins"), F.col("losses"))
    return c.select("target", "wins", "losses", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"WITH {R} SELECT source_key, CASE WHEN multiplier >= 10 THEN 'hot' WHEN multiplier >= 2 THEN 'warm' ELSE 'cold' END AS phase, count(*) AS n FROM rounds GROUP BY ALL")
def label_counts(spark, sf_dir):
    m = F.col("multiplier")
    return rounds(spark, sf_dir).groupBy("source_key", F.when(m >= 10, "hot").when(m >= 2, "warm").otherwise("cold").alias("phase")).agg(F.count(F.lit(1)).alias("n"))
