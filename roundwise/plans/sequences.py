"""Sequence analytics: gaps, runs, rolling statistics, labels and drift.

The sequence is all rounds in the order of ids; operators.ordered keeps it
spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundwise.catalog import query
from roundwise.functions.expressions import token
from roundwise.operators import ordered
from roundwise.plans.fixtures import R, param, rounds

I = f"{R}, i AS (SELECT row_number() OVER (ORDER BY round_id) - 1 AS idx, round_id, multiplier, source_key FROM rounds)"  # noqa: E741
#: Hits of a few targets, spread over the rows.
T = "t(target) AS (VALUES (5), (10), (50))"


def sequence(spark, sf_dir) -> DataFrame:
    return ordered.indexed(rounds(spark, sf_dir).select("round_id", "multiplier", "source_key"))


def by_target(spark, sf_dir, targets=(5, 10, 50)) -> DataFrame:
    return sequence(spark, sf_dir).crossJoin(param(spark, "target int", targets)).withColumn("hit", F.col("multiplier") >= F.col("target"))


@query(f"WITH {I}, {T}, g AS (SELECT target, round_id, idx, multiplier >= target AS hit, max(CASE WHEN multiplier >= target THEN idx END) OVER (PARTITION BY target ORDER BY idx) AS last FROM i, t) SELECT target, round_id, idx - coalesce(last, -1) AS gap_idx FROM g")
def running_gap(spark, sf_dir):
    """Rows since the last hit; the row's number plus one before any hit."""
    c = ordered.carried(by_target(spark, sf_dir), "last", F.when(F.col("hit"), F.col("idx")), ("target",))
    return c.select("target", "round_id", (F.col("idx") - F.coalesce("last", F.lit(-1))).alias("gap_idx"))


@query(f"WITH {I}, {T} SELECT target, round_id, round_id - lag(round_id) OVER w AS gap_id, idx - lag(idx) OVER w AS gap_idx FROM i, t WHERE multiplier >= target WINDOW w AS (PARTITION BY target ORDER BY idx)")
def inter_hit_intervals(spark, sf_dir):
    """Distances between hits in ids and in rows."""
    c = by_target(spark, sf_dir)
    c = ordered.carried(c, "last", F.when(F.col("hit"), F.struct("round_id", "idx")), ("target",), inclusive=False)
    return c.where("hit").select("target", "round_id", (F.col("round_id") - F.col("last.round_id")).alias("gap_id"), (F.col("idx") - F.col("last.idx")).alias("gap_idx"))


@query(f"WITH {I}, {T} SELECT target, round_id, min(CASE WHEN multiplier >= target THEN idx END) OVER (PARTITION BY target ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_idx FROM i, t")
def next_hit(spark, sf_dir):
    """Number of the next row that hits, the row itself left out."""
    c = ordered.carried(by_target(spark, sf_dir), "next_idx", F.when(F.col("hit"), F.col("idx")), ("target",), forward=False, inclusive=False)
    return c.select("target", "round_id", "next_idx")


@query(f"WITH {I}, s AS (SELECT *, idx - coalesce(max(CASE WHEN multiplier >= 2 THEN idx END) OVER w, -1) AS low, idx - coalesce(max(CASE WHEN multiplier < 10 THEN idx END) OVER w, -1) AS high FROM i WINDOW w AS (ORDER BY idx)) SELECT round_id, low AS low_run, high AS high_run FROM s")
def run_lengths(spark, sf_dir):
    """Runs below 2 and runs of 10 or more that end at the row."""
    m = F.col("multiplier")
    c = ordered.runs_all(sequence(spark, sf_dir), {"low_run": m < 2, "high_run": m >= 10})
    return c.select("round_id", "low_run", "high_run")


@query(f"WITH {I} SELECT round_id, round(avg(CASE WHEN multiplier < 2 THEN 1.0 ELSE 0.0 END) OVER (ORDER BY idx ROWS 23 PRECEDING), 9) AS low_rate24, round(avg(CASE WHEN multiplier >= 10 THEN 1.0 ELSE 0.0 END) OVER (ORDER BY idx ROWS 99 PRECEDING), 9) AS high_rate100, count(*) OVER (ORDER BY idx ROWS 23 PRECEDING) AS n24 FROM i")
def rolling_rates(spark, sf_dir):
    m = F.col("multiplier")
    flag = lambda c: c.cast("double")
    c = ordered.framed(sequence(spark, sf_dir), 99, 0, lambda rows: {"low_rate24": F.round(F.avg(flag(m < 2)).over(rows(-23, 0)), 9), "high_rate100": F.round(F.avg(flag(m >= 10)).over(rows(-99, 0)), 9), "n24": F.count(F.lit(1)).over(rows(-23, 0))})
    return c.select("round_id", "low_rate24", "high_rate100", "n24")


@query(f"WITH {I} SELECT round_id, round(coalesce(stddev_pop(ln(multiplier)) OVER (ORDER BY idx ROWS 29 PRECEDING), 0), 6) AS vol30, round(avg(ln(multiplier)) OVER (ORDER BY idx ROWS 29 PRECEDING), 6) AS mean30 FROM i")
def rolling_volatility(spark, sf_dir):
    x = F.ln("multiplier")
    c = ordered.framed(sequence(spark, sf_dir), 29, 0, lambda rows: {"vol30": F.round(F.coalesce(F.stddev_pop(x).over(rows(-29, 0)), F.lit(0.0)), 6), "mean30": F.round(F.avg(x).over(rows(-29, 0)), 6)})
    return c.select("round_id", "vol30", "mean30")


@query(f"WITH {I}, s AS (SELECT idx, idx - coalesce(max(CASE WHEN multiplier >= 2 THEN idx END) OVER (ORDER BY idx), -1) AS low FROM i) SELECT max(low) AS longest, arg_max(low, idx) AS trailing FROM s")
def longest_run(spark, sf_dir):
    c = ordered.runs(sequence(spark, sf_dir), "low", F.col("multiplier") < 2)
    return c.agg(F.max("low").alias("longest"), F.max_by("low", "idx").alias("trailing"))


@query(f"WITH {I}, n AS (SELECT count(*) AS n FROM i) SELECT source_key, round(regr_slope(ln(multiplier), idx) * 1e6, 6) AS slope, round(avg(ln(multiplier)), 6) AS mean FROM i GROUP BY source_key")
def log_trend(spark, sf_dir):
    """Least-squares slope of the log multiplier over row numbers."""
    x = F.ln("multiplier")
    return sequence(spark, sf_dir).groupBy("source_key").agg(F.round(F.regr_slope(x, "idx") * 1e6, 6).alias("slope"), F.round(F.avg(x), 6).alias("mean"))


REGIME = "CASE WHEN trend <= -0.04 AND vol <= 1.02 THEN 'compression' WHEN trend >= 0.035 AND vol >= 1.02 THEN 'expansion' WHEN vol >= 1.18 THEN 'chaotic' WHEN trend <= -0.02 THEN 'soft-down' WHEN trend >= 0.02 THEN 'soft-up' ELSE 'balanced' END"


@query(f"WITH {I}, x AS (SELECT idx, round_id, ln(multiplier) AS x FROM i), f AS (SELECT round_id, idx, avg(x) OVER (ORDER BY idx ROWS 11 PRECEDING) AS m12, coalesce(avg(x) OVER (ORDER BY idx ROWS BETWEEN 23 PRECEDING AND 12 PRECEDING), 0) AS p12, avg(x) OVER (ORDER BY idx ROWS 39 PRECEDING) AS m40, coalesce(avg(x) OVER (ORDER BY idx ROWS BETWEEN 79 PRECEDING AND 40 PRECEDING), 0) AS p40, stddev_pop(x) OVER (ORDER BY idx ROWS 29 PRECEDING) AS s30, stddev_pop(x) OVER (ORDER BY idx ROWS BETWEEN 159 PRECEDING AND 30 PRECEDING) AS s130 FROM x), r AS (SELECT round_id, round(0.65 * (m12 - p12) + 0.35 * (m40 - p40), 6) AS trend, round(s30 / s130, 6) AS vol FROM f WHERE idx >= 160) SELECT round_id, trend, vol, {REGIME} AS regime FROM r")
def regime_labels(spark, sf_dir):
    """Short and long trends of the log multiplier, the volatility ratio and
    their label."""
    x = F.ln("multiplier")
    avg = lambda rows, a, b: F.coalesce(F.avg(x).over(rows(a, b)), F.lit(0.0))
    c = ordered.framed(sequence(spark, sf_dir), 159, 0, lambda rows: {
        "trend": F.round(0.65 * (avg(rows, -11, 0) - avg(rows, -23, -12)) + 0.35 * (avg(rows, -39, 0) - avg(rows, -79, -40)), 6),
        "vol": F.round(F.try_divide(F.stddev_pop(x).over(rows(-29, 0)), F.stddev_pop(x).over(rows(-159, -30))), 6),
    })
    return c.where("idx >= 160").select("round_id", "trend", "vol", F.expr(REGIME).alias("regime"))


@query(f"WITH {I}, l AS (SELECT ln(multiplier) AS x, row_number() OVER (ORDER BY idx DESC) AS back FROM i), a AS (SELECT avg(x) FILTER (WHERE back <= 24) AS m24, avg(x) FILTER (WHERE back BETWEEN 25 AND 48) AS p24, avg(x) FILTER (WHERE back <= 80) AS m80, avg(x) FILTER (WHERE back BETWEEN 81 AND 160) AS p80, stddev_pop(x) FILTER (WHERE back <= 24) AS s24, stddev_pop(x) FILTER (WHERE back <= 200) AS s200 FROM l) SELECT round(m24 - p24, 9) AS short, round(m80 - p80, 9) AS long, round(greatest(-1, least(1, (0.65 * (m24 - p24) + 0.35 * (m80 - p80)) / 0.28)), 9) AS trend, round(s24 / s200, 9) AS vol FROM a")
def trend_context(spark, sf_dir):
    last = rounds(spark, sf_dir).select("round_id", F.ln("multiplier").alias("x")).orderBy(F.desc("round_id")).limit(200)
    l = last.withColumn("back", F.row_number().over(Window.orderBy(F.desc("round_id"))))  # noqa: E741  200 rows
    part = lambda f, a, b: f(F.when(F.col("back").between(a, b), F.col("x")))
    a = l.agg(*[part(F.avg, *ab).alias(n) for n, ab in {"m24": (1, 24), "p24": (25, 48), "m80": (1, 80), "p80": (81, 160)}.items()], part(F.stddev_pop, 1, 24).alias("s24"), F.stddev_pop("x").alias("s200"))
    trend = (0.65 * (F.col("m24") - F.col("p24")) + 0.35 * (F.col("m80") - F.col("p80"))) / 0.28
    return a.select(F.round(F.expr("m24 - p24"), 9).alias("short"), F.round(F.expr("m80 - p80"), 9).alias("long"), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), trend)), 9).alias("trend"), F.round(F.expr("s24 / s200"), 9).alias("vol"))


TOKEN = " + ".join(f"(multiplier >= {c})::INT" for c in (1.2, 1.5, 2, 3, 5, 10, 20, 50))


@query(f"WITH {R} SELECT {TOKEN} AS token, count(*) AS n FROM rounds GROUP BY 1")
def token_counts(spark, sf_dir):
    return rounds(spark, sf_dir).groupBy(token(F.col("multiplier")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {I} SELECT round_id, max(multiplier) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS max1, max(multiplier) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS max3, max(multiplier) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS max5 FROM i")
def future_max(spark, sf_dir):
    c = ordered.framed(sequence(spark, sf_dir), 0, 5, lambda rows: {f"max{h}": F.max("multiplier").over(rows(1, h)) for h in (1, 3, 5)})
    return c.select("round_id", "max1", "max3", "max5")


@query(f"WITH {I}, {T} SELECT target, round_id, coalesce(max(multiplier) OVER (PARTITION BY target ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) >= target, false) AS hit_in_8 FROM i, t")
def exists_in_window(spark, sf_dir):
    """Whether any of the next eight rows hits: a window instead of a semi-join."""
    c = ordered.framed(sequence(spark, sf_dir), 0, 8, lambda rows: {"top": F.max("multiplier").over(rows(1, 8))})
    return c.crossJoin(param(spark, "target int", (5, 10, 50))).select("target", "round_id", F.coalesce(F.col("top") >= F.col("target"), F.lit(False)).alias("hit_in_8"))


@query(f"WITH {I}, s AS (SELECT idx, round_id, {TOKEN} AS token, " + ", ".join(f"idx - coalesce(max(CASE WHEN multiplier >= {t} THEN idx END) OVER w, -1) AS gap{t}" for t in (5, 10, 20, 50, 100)) + " FROM i WINDOW w AS (ORDER BY idx)) SELECT round_id, gap5, gap10, gap20, gap50, gap100, array_to_string(list(token) OVER (ORDER BY idx ROWS 7 PRECEDING), '') AS tokens FROM s")
def state_vectors(spark, sf_dir):
    """Gaps at five thresholds and the last eight tokens."""
    s = sequence(spark, sf_dir).withColumn("token", token(F.col("multiplier")))
    levels = (5, 10, 20, 50, 100)
    s = ordered.carried_all(s, {f"last{t}": F.when(F.col("multiplier") >= t, F.col("idx")) for t in levels})
    s = ordered.framed(s, 7, 0, lambda rows: {"tokens": F.array_join(F.collect_list(F.col("token").cast("string")).over(rows(-7, 0)), "")})
    return s.select("round_id", *[(F.col("idx") - F.coalesce(f"last{t}", F.lit(-1))).alias(f"gap{t}") for t in levels], "tokens")


@query(f"WITH {I}, f AS (SELECT round_id, idx, ln(multiplier) AS x, avg(ln(multiplier)) OVER (ORDER BY idx ROWS 23 PRECEDING) AS mean24, avg(CASE WHEN multiplier < 2 THEN 1.0 ELSE 0.0 END) OVER (ORDER BY idx ROWS 23 PRECEDING) AS low24 FROM i) SELECT round_id, round((mean24 - avg(mean24) OVER ()) / stddev_pop(mean24) OVER (), 6) AS z_mean, round((low24 - avg(low24) OVER ()) / stddev_pop(low24) OVER (), 6) AS z_low FROM f WHERE idx >= 23")
def zscore_features(spark, sf_dir):
    """Rolling features scaled by their own mean and deviation, which one
    aggregate finds and a broadcast of one row brings back."""
    c = ordered.framed(sequence(spark, sf_dir), 23, 0, lambda rows: {"mean24": F.avg(F.ln("multiplier")).over(rows(-23, 0)), "low24": F.avg((F.col("multiplier") < 2).cast("double")).over(rows(-23, 0))}).where("idx >= 23")
    stats = c.agg(*[f(n).alias(a + n) for n in ("mean24", "low24") for a, f in (("m_", F.avg), ("s_", F.stddev_pop))])
    z = lambda n: F.round((F.col(n) - F.col(f"m_{n}")) / F.coalesce(F.nullif(F.col(f"s_{n}"), F.lit(0.0)), F.lit(1.0)), 6)
    return c.crossJoin(F.broadcast(stats)).select("round_id", z("mean24").alias("z_mean"), z("low24").alias("z_low"))


@query(f"WITH {I}, {T}, h AS (SELECT target, CASE WHEN multiplier >= target THEN 1.0 ELSE 0.0 END AS h, lag(CASE WHEN multiplier >= target THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY target ORDER BY idx) AS p FROM i, t) SELECT target, round(coalesce(corr(p, h), 0), 6) AS lag1 FROM h GROUP BY target")
def lag1_corr(spark, sf_dir):
    c = ordered.framed(sequence(spark, sf_dir), 1, 0, lambda rows: {"prev": F.max("multiplier").over(rows(-1, -1))})
    c = c.where("prev IS NOT NULL").crossJoin(param(spark, "target int", (5, 10, 50)))
    flag = lambda n: (F.col(n) >= F.col("target")).cast("double")
    return c.groupBy("target").agg(F.round(F.coalesce(F.corr(flag("prev"), flag("multiplier")), F.lit(0.0)), 6).alias("lag1"))


@query(f"WITH {I}, w AS (SELECT idx // 300 AS win, {TOKEN} AS token FROM i), c AS (SELECT win, token, count(*)::DOUBLE AS n FROM w GROUP BY ALL), g AS (SELECT a.win, k.token FROM (SELECT DISTINCT win FROM w) a, (SELECT unnest(range(9)) AS token) k), p AS (SELECT g.win, g.token, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.win) AS p FROM g LEFT JOIN c ON c.win = g.win AND c.token = g.token), j AS (SELECT a.win, a.p, b.p AS q, (a.p + b.p) / 2 AS m FROM p a JOIN p b ON b.win = a.win - 1 AND b.token = a.token) SELECT win, round(sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2, 6) AS js FROM j GROUP BY win")
def js_divergence(spark, sf_dir):
    """Jensen-Shannon divergence of the token shares of adjacent 300-row windows."""
    s = sequence(spark, sf_dir).select(F.floor(F.col("idx") / 300).alias("win"), token(F.col("multiplier")).alias("token"))
    counts = s.groupBy("win").agg(F.array(*[F.count_if(F.col("token") == k) / F.count(F.lit(1)) for k in range(9)]).alias("p"))
    before = counts.select((F.col("win") + 1).alias("win"), F.col("p").alias("q"))
    kl = lambda a, b: F.when(a > 0, a * F.ln(2 * a / (a + b))).otherwise(0.0)
    js = F.aggregate(F.zip_with("p", "q", lambda a, b: kl(a, b) + kl(b, a)), F.lit(0.0), lambda s, x: s + x) / 2
    return counts.join(before, "win").select("win", F.round(js, 6).alias("js"))


@query(f"WITH {I}, l AS (SELECT ln(multiplier) AS x FROM i), q AS (SELECT quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.4) AS b, quantile_cont(x, 0.6) AS c, quantile_cont(x, 0.8) AS d FROM l), b AS (SELECT (x > a)::INT + (x > b)::INT + (x > c)::INT + (x > d)::INT AS bin FROM l, q) SELECT bin, count(*) AS n FROM b GROUP BY bin")
def entropy_bins(spark, sf_dir):
    """Counts in bins cut at exact quantiles."""
    x = rounds(spark, sf_dir).select(F.ln("multiplier").alias("x"))
    cuts = x.agg(F.percentile("x", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("q"))
    bin_ = F.size(F.filter("q", lambda c: F.col("x") > c))
    return x.crossJoin(F.broadcast(cuts)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {I}, e AS (SELECT idx, round_id, CASE WHEN multiplier >= 2 THEN 1.0 ELSE 0.0 END AS h FROM i) SELECT round_id, round(avg((h - 0.5) * (h - 0.5)) OVER (ORDER BY idx ROWS 99 PRECEDING), 9) AS brier, round(stddev_pop(h) OVER (ORDER BY idx ROWS 99 PRECEDING), 6) AS spread FROM e")
def rolling_brier(spark, sf_dir):
    """Brier score of the fair forecast at 2 over the last 100 rows."""
    h = (F.col("multiplier") >= 2).cast("double")
    c = ordered.framed(sequence(spark, sf_dir), 99, 0, lambda rows: {"brier": F.round(F.avg((h - 0.5) * (h - 0.5)).over(rows(-99, 0)), 9), "spread": F.round(F.stddev_pop(h).over(rows(-99, 0)), 6)})
    return c.select("round_id", "brier", "spread")


@query(f"WITH {I}, b AS (SELECT idx, round_id, CASE WHEN multiplier >= 2 THEN 1.0 ELSE -1.0 END AS pay FROM i), e AS (SELECT idx, round_id, sum(pay) OVER (ORDER BY idx) AS equity FROM b), p AS (SELECT *, greatest(0, max(equity) OVER (ORDER BY idx)) AS peak FROM e) SELECT CAST(arg_max(equity, idx) AS DOUBLE) AS final_equity, CAST(max(peak - equity) AS DOUBLE) AS max_drawdown, CAST(max(peak) AS DOUBLE) AS top FROM p")
def equity_drawdown(spark, sf_dir):
    """Equity of a unit stake at 2 on every round, its peak (from 0) and the
    deepest fall from it: running sums and maxima with carried blocks."""
    s = sequence(spark, sf_dir).withColumn("pay", F.when(F.col("multiplier") >= 2, 1.0).otherwise(-1.0))
    s = ordered.running_sum(s, "equity", F.col("pay")).withColumn("_blk", F.floor(F.col("idx") / ordered.BLOCK))
    own = F.max("equity").over(Window.partitionBy("_blk").orderBy("idx"))
    tops = s.groupBy("_blk").agg(F.max("equity").alias("t"))
    before = tops.select("_blk", F.max("t").over(Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    p = s.withColumn("own", own).join(before, "_blk").withColumn("peak", F.greatest(F.lit(0.0), "own", "before"))
    return p.agg(F.max_by("equity", "idx").alias("final_equity"), F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"), F.max("peak").alias("top"))
