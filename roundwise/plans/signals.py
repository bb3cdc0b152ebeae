"""Signals that forecasts are made of: neighbours, hazards, regimes, boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundwise.catalog import query
from roundwise.functions.expressions import clamp
from roundwise.functions.params import ORACLE_WINDOWS
from roundwise.operators import ordered
from roundwise.plans import probabilities as prob
from roundwise.plans.fixtures import LOCKS, R, locks, param, rounds
from roundwise.plans.sequences import I, by_target, sequence

TAIL = f"{I}, l AS (SELECT *, row_number() OVER (ORDER BY idx DESC) AS back FROM i)"


def tail(spark, sf_dir, n: int) -> DataFrame:
    """The newest n rows with back, 1 for the last: n is small."""
    last = rounds(spark, sf_dir).select("round_id", "multiplier").orderBy(F.desc("round_id")).limit(n)
    return last.withColumn("back", F.row_number().over(Window.orderBy(F.desc("round_id"))))


@query(f"WITH {I}, t(target, recent) AS (VALUES (5, 0.8), (10, 0.8), (50, 0.7)), h AS (SELECT target, recent, idx, multiplier >= target AS hit FROM i, t), n AS (SELECT max(idx) AS n FROM i), g AS (SELECT target, idx - lag(idx) OVER (PARTITION BY target ORDER BY idx) AS gap, idx FROM h WHERE hit), s AS (SELECT target, avg(gap) AS m, stddev_pop(gap) AS sd, max(idx) AS last FROM g GROUP BY target), r AS (SELECT h.target, recent, avg(hit::INT) AS whole, avg(CASE WHEN idx > n - 180 THEN hit::INT END) AS late FROM h, n GROUP BY ALL) SELECT target, round(greatest(0.0, least(1.0, (recent * late + (1 - recent) * whole) * (1 + 0.18 * tanh((n - last - m) / greatest(1e-6, sd))))), 6) AS p FROM r JOIN s USING (target), n")
def recent_hazard(spark, sf_dir):
    """Recent and overall hit rates mixed, lifted by how long the gap is."""
    recent = param(spark, "target int, recent double", ((5, 0.8), (10, 0.8), (50, 0.7)))
    s = by_target(spark, sf_dir)
    c = ordered.carried(s, "last", F.when(F.col("hit"), F.col("idx")), ("target",), inclusive=False)
    n = F.broadcast(s.agg(F.max("idx").alias("n")))
    gap = F.when(F.col("hit"), F.col("idx") - F.col("last"))
    a = c.crossJoin(n).groupBy("target", "n").agg(F.avg(F.col("hit").cast("int")).alias("whole"), F.avg(F.when(F.col("idx") > F.col("n") - 180, F.col("hit").cast("int"))).alias("late"), F.avg(gap).alias("m"), F.stddev_pop(gap).alias("sd"), F.max(F.when(F.col("hit"), F.col("idx"))).alias("at"))
    p = (F.col("recent") * F.col("late") + (1 - F.col("recent")) * F.col("whole")) * (1 + 0.18 * F.tanh((F.col("n") - F.col("at") - F.col("m")) / F.greatest(F.lit(1e-6), F.col("sd"))))
    return a.join(recent, "target").select("target", F.round(clamp(p, 0.0, 1.0), 6).alias("p"))


@query(f"WITH {I}, a AS (SELECT idx, multiplier, ln(multiplier) AS x, avg(ln(multiplier)) OVER (ORDER BY idx ROWS 23 PRECEDING) AS m, avg((multiplier < 2)::INT) OVER (ORDER BY idx ROWS 23 PRECEDING) AS l, lead(multiplier) OVER (ORDER BY idx) >= 10 AS y FROM i), q AS (SELECT * FROM a ORDER BY idx DESC LIMIT 1), d AS (SELECT a.idx, a.y, q.idx - a.idx AS age, round(sqrt((a.x - q.x) * (a.x - q.x) + (a.m - q.m) * (a.m - q.m) + (a.l - q.l) * (a.l - q.l)), 9) AS d FROM a, q WHERE a.idx BETWEEN q.idx - 1800 AND q.idx - 1 AND a.idx >= 23), n AS (SELECT count(*) AS n FROM d), k AS (SELECT * FROM d QUALIFY row_number() OVER (ORDER BY d, idx) <= (SELECT greatest(24, least(120, CAST(floor(sqrt(n) + 0.5) AS BIGINT))) FROM n)) SELECT count(*) AS k, round(avg(d), 6) AS distance, round(sum(1 / greatest(1e-6, d) * exp(-age / 180.0) * y::INT) / sum(1 / greatest(1e-6, d) * exp(-age / 180.0)), 6) AS p FROM k")
def knn_hit_prob(spark, sf_dir):
    """Hits after the rows most like the last one, of 1,800 rows before it."""
    x = F.ln("multiplier")
    a = ordered.framed(sequence(spark, sf_dir), 23, 1, lambda rows: {"x": x, "m": F.avg(x).over(rows(-23, 0)), "l": F.avg((F.col("multiplier") < 2).cast("int")).over(rows(-23, 0)), "next": F.max("multiplier").over(rows(1, 1))})
    q = a.agg(F.max_by(F.struct("idx", "x", "m", "l"), "idx").alias("q"))
    far = F.sqrt(sum((F.col(n) - F.col(f"q.{n}")) * (F.col(n) - F.col(f"q.{n}")) for n in ("x", "m", "l")))
    d = a.crossJoin(F.broadcast(q)).where("idx BETWEEN q.idx - 1800 AND q.idx - 1 AND idx >= 23").select("idx", (F.col("next") >= 10).cast("int").alias("y"), (F.col("q.idx") - F.col("idx")).alias("age"), F.round(far, 9).alias("d"))
    n = d.agg(F.greatest(F.lit(24), F.least(F.lit(120), F.floor(F.sqrt(F.count(F.lit(1))) + 0.5))).alias("k"))
    near = d.orderBy("d", "idx").limit(120)
    k = near.withColumn("place", F.row_number().over(Window.orderBy("d", "idx"))).crossJoin(F.broadcast(n)).where("place <= k")  # 120 rows
    w = 1 / F.greatest(F.lit(1e-6), F.col("d")) * F.exp(-F.col("age") / 180.0)
    return k.agg(F.count(F.lit(1)).alias("k"), F.round(F.avg("d"), 6).alias("distance"), F.round(F.sum(w * F.col("y")) / F.sum(w), 6).alias("p"))


STATE = f"{I}, s AS (SELECT idx, " + ", ".join(f"ln(1 + idx - coalesce(max(CASE WHEN multiplier >= {t} THEN idx END) OVER w, -1)) AS g{t}" for t in (5, 10, 20, 50)) + ", avg((multiplier < 2)::INT) OVER (ORDER BY idx ROWS 23 PRECEDING) AS u, min(CASE WHEN multiplier >= 10 THEN idx END) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM i WINDOW w AS (ORDER BY idx)), q AS (SELECT * FROM s ORDER BY idx DESC LIMIT 1), d AS (SELECT s.idx, s.nxt - s.idx AS ttn, exp(-0.9 * (1.61 * abs(s.g10 - q.g10) + 0.22 * abs(s.g5 - q.g5) + 0.24 * abs(s.g20 - q.g20) + 0.2 * abs(s.g50 - q.g50) + 0.9 * abs(s.u - q.u))) * (0.35 + 0.65 * pow((s.idx + 1) / q.idx::DOUBLE, 1.4)) AS w FROM s, q WHERE s.idx >= 120 AND s.idx < q.idx AND s.nxt IS NOT NULL)"


@query(f"WITH {STATE} SELECT count(*) AS n, round(sum(w * ttn) / sum(w), 6) AS mean_wait, round(0.42 * sum(w * (ttn <= 1)::INT) / sum(w) + 0.28 * sum(w * (ttn <= 2)::INT) / sum(w) + 0.12 * sum(w * (ttn <= 3)::INT) / sum(w), 6) AS quick FROM d WHERE w >= 0.002")
def state_neighbours(spark, sf_dir):
    """Waits after states like the last one, weighted by distance and recency,
    and the chance of a quick hit they give."""
    levels = (5, 10, 20, 50)
    reached = sum(F.when(F.col("multiplier") >= t, 1).otherwise(0) for t in levels)
    s = ordered.states(rounds(spark, sf_dir), reached, len(levels), F.col("multiplier") < 2, 1 + levels.index(10))
    gap = lambda at, idx: F.log1p(F.col(idx) - F.coalesce(at, F.lit(-1)))
    s = s.select("idx", "nxt", "u", *[gap(f"at{k}", "idx").alias(f"g{t}") for k, t in enumerate(levels, 1)], F.struct("q.idx", "q.u", *[gap(f"q.at{k}", "q.idx").alias(f"g{t}") for k, t in enumerate(levels, 1)]).alias("q"))
    # the gap of the target itself and of 10 are the same here: 1.35 + 0.26
    far = sum(w * F.abs(F.col(n) - F.col(f"q.{n}")) for n, w in (("g10", 1.61), ("g5", 0.22), ("g20", 0.24), ("g50", 0.2), ("u", 0.9)))
    recent = 0.35 + 0.65 * F.pow((F.col("idx") + 1) / F.col("q.idx"), F.lit(1.4))
    d = s.where("idx >= 120 AND idx < q.idx AND nxt IS NOT NULL").select((F.col("nxt") - F.col("idx")).alias("ttn"), (F.exp(-0.9 * far) * recent).alias("w")).where("w >= 0.002")
    part = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    within = lambda k: part((F.col("ttn") <= k).cast("int"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(part(F.col("ttn")), 6).alias("mean_wait"), F.round(0.42 * within(1) + 0.28 * within(2) + 0.12 * within(3), 6).alias("quick"))


def pressures(spark, sf_dir, targets) -> DataFrame:
    """target, soft, hard with the floor of 3."""
    q = prob.gaps(spark, sf_dir, targets).groupBy("target").agg(F.percentile("gap", F.array(F.lit(0.75), F.lit(0.9))).alias("q"))
    s = q.join(F.broadcast(prob.since(spark, sf_dir, targets)), "target")
    q75, q90 = F.col("q")[0], F.col("q")[1]
    return s.select("target", clamp((F.col("since") - q75) / F.greatest(F.lit(2.0), q90 - q75 + 1), 0.0, 1.0).alias("soft"), clamp((F.col("since") - q90) / F.greatest(F.lit(3.0), 0.35 * q90 + 2), 0.0, 1.0).alias("hard"))


BOOST_SQL = f"{I}, t(target) AS (VALUES (2), (5), (10), (25), (50)), g AS (SELECT * FROM (SELECT target, round_id - lag(round_id) OVER (PARTITION BY target ORDER BY idx) AS gap FROM i, t WHERE multiplier >= target) WHERE gap IS NOT NULL), s AS (SELECT target, (SELECT max(round_id) FROM i) - max(round_id) AS since FROM i, t WHERE multiplier >= target GROUP BY target), q AS (SELECT target, quantile_cont(gap, 0.75) AS q75, quantile_cont(gap, 0.9) AS q90 FROM g GROUP BY target), p AS (SELECT target, greatest(0, least(1, (since - q75) / greatest(2, q90 - q75 + 1))) AS soft, greatest(0, least(1, (since - q90) / greatest(3, 0.35 * q90 + 2))) AS hard FROM q JOIN s USING (target)), w AS (SELECT " + ", ".join(f"max(soft) FILTER (WHERE target = {t}) AS s{t}, max(hard) FILTER (WHERE target = {t}) AS h{t}" for t in (2, 5, 10, 25, 50)) + " FROM p)"
BOOSTS = {
    "micro": "-0.03 * (s2 + s5 + s10 + s25 + s50) - 0.06 * (h2 + h5 + h10 + h25 + h50)",
    "low": "0.06 * s2 + 0.11 * h2",
    "mid": "0.08 * s5 + 0.17 * h5 + 0.03 * s2",
    "high": "0.11 * s10 + 0.23 * h10 + 0.05 * s5",
    "moon": "0.14 * s25 + 0.28 * h25 + 0.08 * s50 + 0.2 * h50",
}


@query(f"WITH {BOOST_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS bucket, round(({e})::DOUBLE, 6) AS boost FROM w" for n, e in BOOSTS.items()))
def bucket_boosts(spark, sf_dir):
    """How the pressure of five gaps raises and lowers the buckets' shares."""
    targets = (2, 5, 10, 25, 50)
    w = pressures(spark, sf_dir, targets).agg(*[F.max(F.when(F.col("target") == t, F.col(c))).alias(f"{c[0]}{t}") for t in targets for c in ("soft", "hard")])
    return w.select(F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.round(F.expr(e), 6).alias("boost")) for n, e in BOOSTS.items()])).alias("x")).select("x.*")


@query(f"WITH {I}, t(target, soft) AS (VALUES (5, 1.9), (10, 1.9), (15, 2.1), (30, 2.4), (50, 2.7)), g AS (SELECT * FROM (SELECT target, round_id - lag(round_id) OVER (PARTITION BY target ORDER BY idx) AS gap, row_number() OVER (PARTITION BY target ORDER BY idx DESC) AS back FROM i, t WHERE multiplier >= target) WHERE gap IS NOT NULL), m AS (SELECT target, count(*) AS n, quantile_cont(gap, 0.5) AS med, quantile_cont(gap, 0.5) FILTER (WHERE back <= 40) AS recent, least(40, count(*)) AS k FROM g GROUP BY target), l AS (SELECT multiplier, row_number() OVER (ORDER BY idx DESC) AS back FROM i), s AS (SELECT target, avg((multiplier <= soft)::INT) FILTER (WHERE back <= 24) - avg((multiplier <= soft)::INT) FILTER (WHERE back BETWEEN 25 AND 48) AS shift FROM l, t GROUP BY target) SELECT target, CASE WHEN n < 40 OR k < 24 THEN 'full' WHEN abs(recent - med) / med > 0.30 OR abs(shift) > 0.24 THEN 'recent' ELSE 'full' END AS mode FROM m JOIN s USING (target)")
def oracle_regime(spark, sf_dir):
    """Whether the last 40 gaps differ so much that only they should count."""
    softs = ((5, 1.9), (10, 1.9), (15, 2.1), (30, 2.4), (50, 2.7))
    targets = tuple(t for t, _ in softs)
    s = by_target(spark, sf_dir, targets)
    c = ordered.carried(s, "last", F.when(F.col("hit"), F.col("round_id")), ("target",), inclusive=False).where("hit AND last IS NOT NULL")
    g = c.select("target", "idx", (F.col("round_id") - F.col("last")).alias("gap"))
    newest = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("idx")))
    late = g.withColumn("back", newest).where("back <= 40").groupBy("target").agg(F.percentile("gap", 0.5).alias("recent"), F.count(F.lit(1)).alias("k"))
    m = g.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.percentile("gap", 0.5).alias("med")).join(late, "target")
    low = (F.col("multiplier") <= F.col("soft")).cast("int")
    shift = tail(spark, sf_dir, 48).crossJoin(param(spark, "target int, soft double", softs)).groupBy("target").agg((F.avg(F.when(F.col("back") <= 24, low)) - F.avg(F.when(F.col("back") > 24, low))).alias("shift"))
    mode = F.when((F.col("n") < 40) | (F.col("k") < 24), "full").when((F.abs(F.col("recent") - F.col("med")) / F.col("med") > 0.30) | (F.abs("shift") > 0.24), "recent").otherwise("full")
    return m.join(shift, "target").select("target", mode.alias("mode"))


@query(f"WITH {TAIL} SELECT count(*) FILTER (WHERE back <= 24 AND multiplier < 2) AS low24, count(*) FILTER (WHERE back <= 12 AND multiplier < 2) AS low12, count(*) FILTER (WHERE back <= 6 AND multiplier < 2) AS low6, count(*) FILTER (WHERE back <= 24 AND multiplier >= 10) AS high24, coalesce(min(back) FILTER (WHERE multiplier >= 2), 25) - 1 AS trailing_low, max(multiplier) FILTER (WHERE back <= 24) AS top24, count(*) FILTER (WHERE back <= 6 AND multiplier < 2) >= 5 AS drying, count(*) FILTER (WHERE back <= 24 AND multiplier >= 10) >= 4 AS hot FROM l WHERE back <= 24")
def recent_diagnostics(spark, sf_dir):
    """Counts, streaks and flags of the last 24, 12 and 6 rows."""
    m, b = F.col("multiplier"), F.col("back")
    low = lambda k: F.count_if((b <= k) & (m < 2))
    return tail(spark, sf_dir, 24).agg(low(24).alias("low24"), low(12).alias("low12"), low(6).alias("low6"), F.count_if(m >= 10).alias("high24"), (F.coalesce(F.min(F.when(m >= 2, b)), F.lit(25)) - 1).cast("long").alias("trailing_low"), F.max(m).alias("top24"), (low(6) >= 5).alias("drying"), (F.count_if(m >= 10) >= 4).alias("hot"))


@query(f"WITH {prob.HAZ}, gaps AS {prob.G.split(', gaps AS ')[1]}, m AS (SELECT target, greatest(2, avg(gap)) AS mean FROM gaps GROUP BY target), l AS (SELECT a.target, p, coalesce(max(h / nullif(o, 0)::DOUBLE) FILTER (WHERE g = least(since, 60)), p) AS here FROM a JOIN since USING (target) LEFT JOIN o ON o.target = a.target GROUP BY a.target, p) SELECT target, round(greatest(0.00005, least(0.62, 0.72 * here + 0.28 / mean)), 6) AS p_hit1, round(greatest(1, ln(0.5) / ln(1 - greatest(0.00005, least(0.62, 0.72 * here + 0.28 / mean)))), 3) AS q50 FROM l JOIN m USING (target)")
def hazard_eta(spark, sf_dir):
    """Wait for a hit from the unsmoothed hazard at the present gap, mixed with
    one over the mean gap."""
    c = ordered.carried(by_target(spark, sf_dir), "last", F.when(F.col("hit"), F.col("idx")), ("target",))
    c = ordered.framed(c, 0, 1, lambda rows: {"next": F.max("multiplier").over(rows(1, 1))}, ("target",)).where("next IS NOT NULL")
    hit = (F.col("next") >= F.col("target")).cast("int")
    c = c.join(F.broadcast(prob.since(spark, sf_dir)), "target")
    at = F.least(F.lit(60), F.col("idx") - F.coalesce("last", F.lit(-1))) == F.least(F.col("since"), F.lit(60))
    l = c.groupBy("target").agg(F.coalesce(F.avg(F.when(at, hit)), F.avg(hit)).alias("here"))  # noqa: E741
    m = prob.gaps(spark, sf_dir).groupBy("target").agg(F.greatest(F.lit(2.0), F.avg("gap")).alias("mean"))
    p = clamp(0.72 * F.col("here") + 0.28 / F.col("mean"), 0.00005, 0.62)
    return l.join(m, "target").select("target", F.round(p, 6).alias("p_hit1"), F.round(F.greatest(F.lit(1.0), F.ln(F.lit(0.5)) / F.ln(1 - p)), 3).alias("q50"))


@query(f"WITH {I}, w AS (SELECT idx, avg((multiplier >= 10)::INT) OVER (ORDER BY idx ROWS 299 PRECEDING) AS r FROM i) SELECT count(*) AS sample, round(quantile_cont(abs(r - 0.1), 0.35), 9) AS drift FROM w WHERE idx >= 600 AND idx % 12 = 0")
def entropy_thresholds(spark, sf_dir):
    """The drift threshold calibrates itself: a low quantile of how far the rate
    of 300 rows was from fair, every twelve rows. Rates of 300 rows have 301 values at
    most, so the exact quantile holds no more."""
    c = ordered.framed(sequence(spark, sf_dir), 299, 0, lambda rows: {"r": F.avg((F.col("multiplier") >= 10).cast("int")).over(rows(-299, 0))})
    return c.where("idx >= 600 AND idx % 12 = 0").agg(F.count(F.lit(1)).alias("sample"), F.round(F.percentile(F.abs(F.col("r") - 0.1), 0.35), 9).alias("drift"))


@query(f"WITH {I}, e AS (SELECT idx, multiplier >= 2 AS y, coalesce(avg((multiplier >= 2)::INT) OVER (ORDER BY idx ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 0.5) AS recent FROM i), s AS (SELECT avg(abs(y::INT - recent)) AS a, avg(abs(y::INT - 0.5)) AS b, count(*) AS n FROM e WHERE idx >= 50) SELECT n AS samples, round((1 / greatest(1e-6, a)) / (1 / greatest(1e-6, a) + 1 / greatest(1e-6, b)), 9) AS recent, round((1 / greatest(1e-6, b)) / (1 / greatest(1e-6, a) + 1 / greatest(1e-6, b)), 9) AS fair FROM s")
def blend_weights(spark, sf_dir):
    """Weights of two forecasters by their inverse mean errors."""
    y = (F.col("multiplier") >= 2).cast("int")
    c = ordered.framed(sequence(spark, sf_dir), 50, 0, lambda rows: {"recent": F.coalesce(F.avg(y).over(rows(-50, -1)), F.lit(0.5))}).where("idx >= 50")
    s = c.agg(F.avg(F.abs(y - F.col("recent"))).alias("a"), F.avg(F.abs(y - 0.5)).alias("b"), F.count(F.lit(1)).alias("samples"))
    inv = lambda n: 1 / F.greatest(F.lit(1e-6), F.col(n))
    return s.select("samples", F.round(inv("a") / (inv("a") + inv("b")), 9).alias("recent"), F.round(inv("b") / (inv("a") + inv("b")), 9).alias("fair"))


@query(f"WITH {prob.G}, w(target, k) AS (VALUES (5, {ORACLE_WINDOWS[5]}), (10, {ORACLE_WINDOWS[10]}), (50, {ORACLE_WINDOWS[50]})) SELECT target, k AS width, round(1 - pow(1 - 1.0 / target, k), 9) AS fair, round(avg((gap <= k)::INT), 9) AS seen FROM gaps JOIN w USING (target) GROUP BY ALL")
def window_chances(spark, sf_dir):
    """Share of gaps within each forecast window beside the fair chance."""
    w = param(spark, "target int, width int", [(t, ORACLE_WINDOWS[t]) for t in (5, 10, 50)])
    g = prob.tally(spark, sf_dir).join(w, "target").groupBy("target", "width").agg((F.sum(F.when(F.col("gap") <= F.col("width"), F.col("n")).otherwise(0)) / F.sum("n")).alias("s"))
    return g.select("target", "width", F.round(1 - F.pow(1 - 1.0 / F.col("target"), F.col("width")), 9).alias("fair"), F.round("s", 9).alias("seen"))
