"""What must hold before a lock is made: thresholds that calibrate themselves, the
state they give, regimes, and the blend of forecasts by their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundwise.catalog import ORACLES, query
from roundwise.operators import ordered, quantiles
from roundwise.plans.fixtures import param
from roundwise.plans.sequences import I, lag1_corr, sequence

# Windows of rows, quantiles of the scores, and thresholds of regimes.
WHITE, SHORT, LONG, NEAR, FAR = 36, 24, 96, 15, 180
QUANTILES = {"white": 0.82, "release": 0.60, "momentum": 0.62}
RUN_QUANTILE = 0.75
VOLATILE, CLUSTERED, LAGGED, DRIFTED = 0.20, 0.18, 0.10, 0.05
BANDS = ((0.82, "VERY HIGH"), (0.66, "HIGH"), (0.44, "MED"), (0.22, "LOW"))
HAZARD_MOST, BASE_LEAST, LEAST_ERROR = 0.25, 0.15, 1e-6
TARGETS = (5, 10, 50)

_AVG = lambda c, a, b: f"avg(({c})::INT) OVER (ORDER BY idx ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"
_STD = lambda n: f"stddev_pop(ln(multiplier)) OVER (ORDER BY idx ROWS {n - 1} PRECEDING)"
_HITS = ", ".join(f"{_AVG(f'multiplier >= {t}', NEAR - 1, 0)} AS near{t}, {_AVG(f'multiplier >= {t}', FAR - 1, 0)} AS far{t}" for t in TARGETS)
_BASE = f"""{I}, b AS (SELECT idx, {_AVG('multiplier < 2', WHITE - 1, 0)} AS white, coalesce({_AVG('multiplier < 2', 2 * WHITE - 1, WHITE)}, 0) AS before,
  CASE WHEN multiplier < 2 THEN idx - coalesce(max(CASE WHEN multiplier >= 2 THEN idx END) OVER (ORDER BY idx), -1) ELSE 0 END AS run,
  ({_STD(SHORT)} - {_STD(LONG)}) / greatest(1e-6, {_STD(LONG)}) AS shift, {_HITS} FROM i),
r AS (SELECT greatest(2, floor(quantile_cont(run, {RUN_QUANTILE}) + 0.5)) AS run_threshold FROM b WHERE run > 0 AND idx >= 1),
e AS (SELECT b.*, run_threshold, round(greatest(0, least(1, shift)), 9) AS expansion FROM b, r WHERE idx >= 1),
s AS (SELECT e.*, t.target, CASE t.target {' '.join(f'WHEN {t} THEN near{t} - far{t}' for t in TARGETS)} END AS drift,
  round(0.60 * white + 0.25 * least(1, run / run_threshold) + 0.15 * (1 - expansion), 9) AS white_score,
  round(CASE WHEN run > run_threshold THEN expansion * greatest(0, before - white) ELSE 0 END, 9) AS release_score,
  round(0.70 * CASE t.target {' '.join(f'WHEN {t} THEN near{t} - far{t}' for t in TARGETS)} END + 0.30 * expansion, 9) AS momentum_score
  FROM e, (VALUES {', '.join(f'({t})' for t in TARGETS)}) t(target))"""


def scores(spark, sf_dir) -> DataFrame:
    """idx, target, the three scores, run_threshold, shift (of volatility) and drift
    (of the hit rate)."""
    low, x = F.col("multiplier") < 2, F.ln("multiplier")
    rate = lambda c, window: F.avg(c.cast("int")).over(window)
    s = ordered.runs(sequence(spark, sf_dir), "run", low)
    s = ordered.framed(s, FAR - 1, 0, lambda rows: {
        "white": rate(low, rows(1 - WHITE, 0)), "before": F.coalesce(rate(low, rows(1 - 2 * WHITE, -WHITE)), F.lit(0.0)),
        "short": F.stddev_pop(x).over(rows(1 - SHORT, 0)), "long": F.stddev_pop(x).over(rows(1 - LONG, 0)),
        **{f"drift{t}": rate(F.col("multiplier") >= t, rows(1 - NEAR, 0)) - rate(F.col("multiplier") >= t, rows(1 - FAR, 0)) for t in TARGETS},
    }).where("idx >= 1").withColumn("shift", (F.col("short") - F.col("long")) / F.greatest(F.lit(1e-6), F.col("long")))
    lengths = s.where("run > 0").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    least = lengths.agg(F.greatest(F.lit(2.0), F.floor(F.percentile("run", RUN_QUANTILE, F.col("n")) + 0.5)).alias("run_threshold"))
    s = s.crossJoin(F.broadcast(least)).withColumn("expansion", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("shift"))), 9))
    s = s.withColumn("x", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"drift{t}").alias("drift")) for t in TARGETS])))
    run, e = F.col("run"), F.col("expansion")
    return s.select(
        "idx", "x.target", "x.drift", "shift", "run_threshold",
        F.round(0.60 * F.col("white") + 0.25 * F.least(F.lit(1.0), run / F.col("run_threshold")) + 0.15 * (1 - e), 9).alias("white_score"),
        F.round(F.when(run > F.col("run_threshold"), e * F.greatest(F.lit(0.0), F.col("before") - F.col("white"))).otherwise(0.0), 9).alias("release_score"),
        F.round(0.70 * F.col("x.drift") + 0.30 * e, 9).alias("momentum_score"),
    )


@query(f"""WITH {_BASE}, q AS (SELECT target, count(*) AS sample, any_value(run_threshold) AS run_threshold, quantile_cont(white_score, {QUANTILES['white']}) AS white, quantile_cont(release_score, {QUANTILES['release']}) FILTER (WHERE release_score > 0) AS release, quantile_cont(momentum_score, {QUANTILES['momentum']}) AS momentum FROM s GROUP BY target),
l AS (SELECT * FROM s WHERE idx = (SELECT max(idx) FROM s))
SELECT target, sample, CAST(q.run_threshold AS BIGINT) AS run_threshold, round(q.white, 6) AS white, round(q.release, 6) AS release, round(q.momentum, 6) AS momentum,
  CASE WHEN white_score > q.white THEN 'WHITE_DOMINANT' WHEN release_score > q.release THEN 'RELEASE_PHASE' WHEN momentum_score > q.momentum THEN 'MOMENTUM' ELSE 'NEUTRAL' END AS state FROM q JOIN l USING (target)""")
def precondition_thresholds(spark, sf_dir):
    """Thresholds as quantiles of each score over the history, and the state of the
    newest row: which score, in order, is above its own."""
    s = scores(spark, sf_dir)
    whole = s.groupBy("target").agg(F.count(F.lit(1)).alias("sample"), F.max("run_threshold").alias("run_threshold"), F.max_by(F.struct("white_score", "release_score", "momentum_score"), "idx").alias("last"))
    for name, q in QUANTILES.items():
        some = s.where("release_score > 0") if name == "release" else s
        whole = whole.join(quantiles.interpolated(some, ("target",), f"{name}_score", {name: q}), "target", "left")
    above = lambda name: F.col(f"last.{name}_score") > F.col(name)
    state = F.when(above("white"), "WHITE_DOMINANT").when(above("release"), "RELEASE_PHASE").when(above("momentum"), "MOMENTUM").otherwise("NEUTRAL")
    return whole.select("target", "sample", F.col("run_threshold").cast("long").alias("run_threshold"), *[F.round(n, 6).alias(n) for n in QUANTILES], state.alias("state"))


@query(f"""WITH {_BASE}, l AS (SELECT * FROM s WHERE idx = (SELECT max(idx) FROM s)), c AS ({ORACLES['lag1_corr']}), x AS (SELECT l.target, shift, abs(lag1) AS lag, abs(drift) AS drift FROM l JOIN c USING (target)),
y AS (SELECT *, CASE WHEN shift > {VOLATILE} THEN 'VOLATILE' WHEN lag > {CLUSTERED} THEN 'CLUSTERED' WHEN lag > {LAGGED} OR drift > {DRIFTED} THEN 'TRENDING' ELSE 'RANDOM' END AS regime FROM x)
SELECT target, regime, CASE regime WHEN 'VOLATILE' THEN 1.25 WHEN 'CLUSTERED' THEN 1.12 WHEN 'TRENDING' THEN 1.0 ELSE 1.15 END::DOUBLE AS window_factor, round(least(1, drift / 0.1 + lag), 6) AS score,
  CASE WHEN round(least(1, drift / 0.1 + lag), 6) >= 0.82 THEN 'VERY HIGH' WHEN round(least(1, drift / 0.1 + lag), 6) >= 0.66 THEN 'HIGH' WHEN round(least(1, drift / 0.1 + lag), 6) >= 0.44 THEN 'MED' WHEN round(least(1, drift / 0.1 + lag), 6) >= 0.22 THEN 'LOW' ELSE 'NONE' END AS band FROM y""")
def regime_classes(spark, sf_dir):
    """The regime of each target by volatility, lag correlation and drift, the factor
    its windows get, and how far it is from plain chance, in bands."""
    s = scores(spark, sf_dir).groupBy("target").agg(F.max_by(F.struct("shift", "drift"), "idx").alias("l")).join(F.broadcast(lag1_corr(spark, sf_dir)), "target")
    shift, lag, drift = F.col("l.shift"), F.abs("lag1"), F.abs("l.drift")
    regime = F.when(shift > VOLATILE, "VOLATILE").when(lag > CLUSTERED, "CLUSTERED").when((lag > LAGGED) | (drift > DRIFTED), "TRENDING").otherwise("RANDOM")
    out = s.select("target", regime.alias("regime"), F.round(F.least(F.lit(1.0), drift / 0.1 + lag), 6).alias("score"))
    factor = F.when(F.col("regime") == "VOLATILE", 1.25).when(F.col("regime") == "CLUSTERED", 1.12).when(F.col("regime") == "TRENDING", 1.0).otherwise(1.15)
    return out.withColumn("window_factor", factor).withColumn("band", band(F.col("score")))


def band(score: Column) -> Column:
    out = F.when(F.lit(False), "")
    for least, name in BANDS:
        out = out.when(score >= least, name)
    return out.otherwise("NONE")


def blend(brier: dict[str, Column], reliability: Column, boost: Column) -> dict[str, Column]:
    """Weights of base, hazard and knn by their inverse Brier scores: the hazard's is
    capped, the base's has a floor, and the neighbours' is scaled at the end."""
    w = {k: 1 / F.greatest(F.lit(LEAST_ERROR), b) for k, b in brier.items()}
    total = w["base"] + w["hazard"] + w["knn"]
    w = {k: v / total for k, v in w.items()}
    excess, rest = F.greatest(F.lit(0.0), w["hazard"] - HAZARD_MOST), w["base"] + w["knn"]
    w = {"base": w["base"] + excess * w["base"] / rest, "hazard": F.least(w["hazard"], F.lit(HAZARD_MOST)), "knn": w["knn"] + excess * w["knn"] / rest}
    need, donor = F.greatest(F.lit(0.0), BASE_LEAST - w["base"]), w["hazard"] + w["knn"]
    w = {"base": w["base"] + need, "hazard": w["hazard"] - need * w["hazard"] / donor, "knn": w["knn"] - need * w["knn"] / donor}
    w["knn"] = w["knn"] * reliability * (1 + F.greatest(F.lit(0.0), F.least(F.lit(0.20), boost)))
    total = w["base"] + w["hazard"] + w["knn"]
    return {k: v / total for k, v in w.items()}


_H = "CASE WHEN multiplier >= target THEN 1.0 ELSE 0.0 END"


@query(f"""WITH {I}, t(target) AS (VALUES (5), (10), (50)), f AS (SELECT idx, target, {_H} AS h, 1.0 / target AS base, coalesce(avg({_H}) OVER (PARTITION BY target ORDER BY idx ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), 1.0 / target) AS hazard, coalesce(avg({_H}) OVER (PARTITION BY target ORDER BY idx ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING), 1.0 / target) AS knn FROM i, t),
b AS (SELECT target, avg((h - base) * (h - base)) AS b, avg((h - hazard) * (h - hazard)) AS z, avg((h - knn) * (h - knn)) AS k FROM f WHERE idx >= 100 GROUP BY target),
w AS (SELECT target, b, z, k, (1 / greatest({LEAST_ERROR}, b)) / (1 / greatest({LEAST_ERROR}, b) + 1 / greatest({LEAST_ERROR}, z) + 1 / greatest({LEAST_ERROR}, k)) AS wb, (1 / greatest({LEAST_ERROR}, z)) / (1 / greatest({LEAST_ERROR}, b) + 1 / greatest({LEAST_ERROR}, z) + 1 / greatest({LEAST_ERROR}, k)) AS wz, (1 / greatest({LEAST_ERROR}, k)) / (1 / greatest({LEAST_ERROR}, b) + 1 / greatest({LEAST_ERROR}, z) + 1 / greatest({LEAST_ERROR}, k)) AS wk FROM b),
c AS (SELECT target, wb + greatest(0, wz - {HAZARD_MOST}) * wb / (wb + wk) AS wb, least(wz, {HAZARD_MOST}) AS wz, wk + greatest(0, wz - {HAZARD_MOST}) * wk / (wb + wk) AS wk FROM w),
d AS (SELECT target, wb + greatest(0, {BASE_LEAST} - wb) AS wb, wz - greatest(0, {BASE_LEAST} - wb) * wz / (wz + wk) AS wz, (wk - greatest(0, {BASE_LEAST} - wb) * wk / (wz + wk)) * 0.8 * 1.05 AS wk FROM c)
SELECT target, round(wb / (wb + wz + wk), 9) AS base, round(wz / (wb + wz + wk), 9) AS hazard, round(wk / (wb + wz + wk), 9) AS knn FROM d""")
def brier_blend(spark, sf_dir):
    """Weights of the fair rate, of the rate of 100 and of 25 rows before, by their
    Brier scores over the history."""
    s = sequence(spark, sf_dir).crossJoin(param(spark, "target int", TARGETS))
    h, fair = (F.col("multiplier") >= F.col("target")).cast("double"), 1.0 / F.col("target")
    f = ordered.framed(s, 100, 0, lambda rows: {"base": fair, "hazard": F.coalesce(F.avg(h).over(rows(-100, -1)), fair), "knn": F.coalesce(F.avg(h).over(rows(-25, -1)), fair)}, ("target",)).where("idx >= 100")
    b = f.groupBy("target").agg(*[F.avg((h - F.col(n)) * (h - F.col(n))).alias(n) for n in ("base", "hazard", "knn")])
    w = blend({n: F.col(n) for n in ("base", "hazard", "knn")}, F.lit(0.8), F.lit(0.05))
    return b.select("target", *[F.round(w[n], 9).alias(n) for n in ("base", "hazard", "knn")])
