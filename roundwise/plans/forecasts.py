"""Feature vectors, clusters, forecasts, replays and back-tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundwise.catalog import ORACLES, query
from roundwise.functions.expressions import token
from roundwise.functions.params import ORACLE_WINDOWS, SPANS
from roundwise.operators import clustering, folds, ordered
from roundwise.plans import probabilities as prob
from roundwise.plans import sequences, statistics
from roundwise.plans.fixtures import R, param, rounds
from roundwise.plans.sequences import TOKEN, I, by_target, sequence

#: Rows that one task may hold.
FEW = 1500
_W = "OVER (ORDER BY idx ROWS 23 PRECEDING)"
F16 = f"{I}, f AS (SELECT idx, round_id, ln(multiplier) AS x, avg(ln(multiplier)) {_W} AS avg_log, stddev_pop(ln(multiplier)) {_W} AS sd_log, avg(ln(multiplier)) OVER (ORDER BY idx ROWS 4 PRECEDING) - avg(ln(multiplier)) OVER (ORDER BY idx ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS momentum, max(ln(multiplier)) {_W} - min(ln(multiplier)) {_W} AS spread, list_sort(list(ln(multiplier)) {_W}) AS s, avg((multiplier < 2)::INT) {_W} AS under2, avg((multiplier >= 10)::INT) {_W} AS over10, avg((multiplier >= 25)::INT) {_W} AS over25, idx - coalesce(max(CASE WHEN multiplier >= 2 THEN idx END) OVER w, -1) AS low_run, idx - coalesce(max(CASE WHEN multiplier < 10 THEN idx END) OVER w, -1) AS high_run, " + ", ".join(f"idx - coalesce(max(CASE WHEN multiplier >= {t} THEN idx END) OVER w, -1) AS gap{t}" for t in (2, 5, 10, 25)) + " FROM i WINDOW w AS (ORDER BY idx))"
NAMES16 = ("avg_log", "sd_log", "last_log", "momentum", "spread", "quartiles", "under2", "over10", "over25", "low_run", "high_run", "gap2", "gap5", "gap10", "gap25", "above")


def features16(spark, sf_dir) -> DataFrame:
    """idx, round_id and the sixteen features over 24 rows."""
    m, x = F.col("multiplier"), F.ln("multiplier")
    s = sequence(spark, sf_dir)
    levels = (2, 5, 10, 25)
    s = ordered.runs_all(s, {"low_run": m < 2, "high_run": m >= 10})
    s = ordered.carried_all(s, {f"at{t}": F.when(m >= t, F.col("idx")) for t in levels}).withColumns({f"gap{t}": F.col("idx") - F.coalesce(f"at{t}", F.lit(-1)) for t in levels})
    rate = lambda c, rows: F.avg(c.cast("int")).over(rows(-23, 0))
    s = ordered.framed(s, 23, 0, lambda rows: {
        "avg_log": F.avg(x).over(rows(-23, 0)), "sd_log": F.stddev_pop(x).over(rows(-23, 0)), "last_log": x,
        "momentum": F.avg(x).over(rows(-4, 0)) - F.avg(x).over(rows(-9, -5)),
        "spread": F.max(x).over(rows(-23, 0)) - F.min(x).over(rows(-23, 0)),
        "_s": F.sort_array(F.collect_list(x).over(rows(-23, 0))),
        "under2": rate(m < 2, rows), "over10": rate(m >= 10, rows), "over25": rate(m >= 25, rows),
    }).where("idx >= 23")
    quartiles = F.get("_s", F.lit(18)) - F.get("_s", F.lit(6))  # floor-index quartiles of 24
    return s.withColumn("quartiles", quartiles).withColumn("above", F.col("last_log") - F.col("avg_log")).select("idx", "round_id", *NAMES16)


@query(f"WITH {F16} SELECT round_id, round(avg_log, 6) AS avg_log, round(sd_log, 6) AS sd_log, round(x, 6) AS last_log, round(momentum, 6) AS momentum, round(spread, 6) AS spread, round(s[19] - s[7], 6) AS quartiles, round(under2, 6) AS under2, round(over10, 6) AS over10, round(over25, 6) AS over25, low_run, high_run, gap2, gap5, gap10, gap25, round(x - avg_log, 6) AS above FROM f WHERE idx >= 23")
def feature16(spark, sf_dir):
    f = features16(spark, sf_dir)
    return f.select("round_id", *[F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in f.dtypes if n in NAMES16])


@query(f"WITH {I}, f AS (SELECT idx, round_id, ln(multiplier) AS prev, coalesce(lag(ln(multiplier)) OVER (ORDER BY idx), ln(multiplier)) AS prev2, avg(ln(multiplier)) {_W} AS short_mean, avg(ln(multiplier)) OVER (ORDER BY idx ROWS 95 PRECEDING) AS long_mean, stddev_pop(ln(multiplier)) OVER (ORDER BY idx ROWS 63 PRECEDING) AS vol, avg((multiplier < 2)::INT) {_W} AS low_short, avg((multiplier < 2)::INT) OVER (ORDER BY idx ROWS 95 PRECEDING) AS low_long, avg((multiplier >= 10)::INT) OVER (ORDER BY idx ROWS 95 PRECEDING) AS hit_long, avg((multiplier >= 10)::INT) {_W} AS hit_short, least(1.0, (idx - coalesce(max(CASE WHEN multiplier >= 10 THEN idx END) OVER w, -1)) / 10.0) AS gap_norm, least(1.0, (idx - coalesce(max(CASE WHEN multiplier >= 2 THEN idx END) OVER w, -1)) / 12.0) AS run_norm FROM i WINDOW w AS (ORDER BY idx)) SELECT round_id, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("prev", "prev2", "short_mean", "long_mean", "vol", "low_short", "low_long", "hit_long", "gap_norm", "run_norm", "hit_short")) + ", round(hit_short - hit_long, 6) AS hit_momentum FROM f")
def feature12(spark, sf_dir):
    """The twelve features of target 10 over 24, 64 and 96 rows."""
    m, x = F.col("multiplier"), F.ln("multiplier")
    s = ordered.runs(sequence(spark, sf_dir), "run", m < 2)
    s = ordered.carried(s, "last", F.when(m >= 10, F.col("idx")))
    rate = lambda c, rows, k: F.avg(c.cast("int")).over(rows(1 - k, 0))
    s = ordered.framed(s, 95, 0, lambda rows: {
        "prev": x, "prev2": F.coalesce(F.max(x).over(rows(-1, -1)), x), "short_mean": F.avg(x).over(rows(-23, 0)), "long_mean": F.avg(x).over(rows(-95, 0)),
        "vol": F.stddev_pop(x).over(rows(-63, 0)), "low_short": rate(m < 2, rows, 24), "low_long": rate(m < 2, rows, 96), "hit_long": rate(m >= 10, rows, 96), "hit_short": rate(m >= 10, rows, 24),
    })
    s = s.withColumns({"gap_norm": F.least(F.lit(1.0), (F.col("idx") - F.coalesce("last", F.lit(-1))) / 10.0), "run_norm": F.least(F.lit(1.0), F.col("run") / 12.0), "hit_momentum": F.col("hit_short") - F.col("hit_long")})
    names = ("prev", "prev2", "short_mean", "long_mean", "vol", "low_short", "low_long", "hit_long", "gap_norm", "run_norm", "hit_short", "hit_momentum")
    return s.select("round_id", *[F.round(n, 6).alias(n) for n in names])


@query(f"WITH {I}, n AS (SELECT count(*) AS n FROM i), x AS (SELECT idx, ln(multiplier) AS x, ({TOKEN}) AS k, multiplier FROM i), cur AS (SELECT list(x ORDER BY idx) AS cx, list(k ORDER BY idx) AS ck FROM x, n WHERE idx >= n - 16), w AS (SELECT idx AS start, list(x) OVER f AS vx, list(k) OVER f AS vk, max(multiplier) OVER (ORDER BY idx ROWS BETWEEN 16 FOLLOWING AND 20 FOLLOWING) AS max5 FROM x WINDOW f AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)), d AS (SELECT start, max5, list_sum(list_transform(range(1, 17), lambda j: (1 + (j - 1) / 16.0 * 2.3) * (0.62 * greatest(0, least(1, 1 - abs(ck[j] - vk[j]) / 8.0)) + 0.38 * greatest(0, least(1, 1 - abs(cx[j] - vx[j]) / 2.6))))) / list_sum(list_transform(range(1, 17), lambda j: 1 + (j - 1) / 16.0 * 2.3)) AS s FROM w, cur, n WHERE start <= least(n - 5 - 1, n - 16 - 1) - 15), k AS (SELECT start, max5, s FROM d WHERE s >= (SELECT quantile_cont(s, 0.82) FROM d) ORDER BY round(s, 9) DESC, start LIMIT 260) SELECT count(*) AS n, round(avg(s), 6) AS mean_similarity, round(sum(pow(s, 2.8) * (max5 >= 10)::INT) / sum(pow(s, 2.8)), 6) AS p_hit5 FROM k")
def analogues_weighted(spark, sf_dir):
    """Stretches of 16 rounds like the last ones by tokens and values, later
    places weighing more; what followed them, weighted by similarity."""
    x = F.ln("multiplier")
    s = sequence(spark, sf_dir).withColumn("k", token(F.col("multiplier")))
    w = ordered.framed(s, 0, 20, lambda rows: {"vx": F.collect_list(x).over(rows(0, 15)), "vk": F.collect_list(F.col("k").cast("double")).over(rows(0, 15)), "max5": F.max("multiplier").over(rows(16, 20))}).select(F.col("idx").alias("start"), "vx", "vk", "max5")
    last = w.where(F.size("vx") == 16).agg(F.max_by(F.struct("vx", "vk"), "start").alias("c"), (F.max("start") + 16).alias("n"))
    pairs = w.crossJoin(F.broadcast(last)).where(F.col("start") <= F.least(F.col("n") - 6, F.col("n") - 17) - 15)
    near = lambda a, b, by: F.zip_with(a, b, lambda p, q: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(p - q) / by)))
    each = F.zip_with(near("vk", "c.vk", 8.0), near("vx", "c.vx", 2.6), lambda p, q: 0.62 * p + 0.38 * q)
    weights = [1 + j / 16.0 * 2.3 for j in range(16)]
    total = F.aggregate(F.zip_with(each, F.array(*map(F.lit, weights)), lambda p, q: p * q), F.lit(0.0), lambda a, b: a + b)
    d = pairs.select("start", "max5", (total / sum(weights)).alias("s"))
    # The best 260 of those above the 82 % quantile. Of over FEW rows, 18 % are more
    # than 260, so the quantile only matters for fewer, all of which are among the best FEW.
    best = d.orderBy(F.round("s", 9).desc(), "start").limit(FEW)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    cut = best.agg(F.percentile("s", 0.82).alias("cut")).crossJoin(n).select(F.when(F.col("n") <= FEW, F.col("cut")).otherwise(-1.0).alias("cut"))
    k = best.crossJoin(F.broadcast(cut)).where("s >= cut").orderBy(F.round("s", 9).desc(), "start").limit(260)
    weight = F.pow(F.col("s"), F.lit(2.8))
    return k.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean_similarity"), F.round(F.sum(weight * (F.col("max5") >= 10).cast("int")) / F.sum(weight), 6).alias("p_hit5"))


def scaled16(spark, sf_dir) -> DataFrame:
    """idx, the sixteen features as z-scores, and what came next."""
    f = features16(spark, sf_dir)
    m = F.max("multiplier")
    f = ordered.framed(f.join(sequence(spark, sf_dir).select("round_id", "multiplier"), "round_id"), 0, 5, lambda rows: {"next": m.over(rows(1, 1)), "ahead5": m.over(rows(1, 5))})
    stats = f.agg(*[g(n).alias(p + n) for n in NAMES16 for p, g in (("m_", F.avg), ("s_", F.stddev_pop))])
    z = [((F.col(n) - F.col(f"m_{n}")) / F.coalesce(F.nullif(F.col(f"s_{n}"), F.lit(0.0)), F.lit(1.0))).alias(n) for n in NAMES16]
    return f.crossJoin(F.broadcast(stats)).select((F.col("idx") - 23).alias("idx"), *z, "next", "ahead5")


@query()
def kmeans_regimes(spark, sf_dir):
    """Clusters of the scaled features, their number chosen from 4 to 12: size, mean
    next multiplier, hit rates and best of the next five of each. The k rows of
    the result are computed before the features are let go."""
    v = scaled16(spark, sf_dir).persist()
    try:
        centres = clustering.chosen(v, list(NAMES16), range(4, 13))
        schema = "cluster int, n long, mean_next double, p_hit2 double, p_hit5 double, p_hit10 double, mean_best5 double"
        if not len(centres):
            return spark.createDataFrame([], schema)
        hit = lambda t: F.round(F.avg((F.col("next") >= t).cast("int")), 6)
        c = clustering.assigned(v.where("next IS NOT NULL"), list(NAMES16), centres).groupBy("cluster")
        rows = c.agg(F.count(F.lit(1)), F.round(F.avg("next"), 6), hit(2), hit(5), hit(10), F.round(F.avg("ahead5"), 6)).collect()
        return spark.createDataFrame([tuple(r) for r in rows], schema)
    finally:
        v.unpersist()


@query()
def tower_forecast(spark, sf_dir):
    """Forecasts of ten-letter sequences of each source and how they did."""
    from roundwise.sources.feeds import READ_LETTERS

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long") % 3
    letter = F.element_at(F.array(*map(F.lit, sorted(READ_LETTERS.values()))), (k + 1).cast("int"))
    t = e.groupBy(F.floor(F.col("event_id") / 10).alias("round_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", letter.alias("l")))), lambda x: x["l"]), "").alias("letters"))
    t = t.where(F.length("letters") >= 4).withColumn("source_key", F.concat(F.lit("s"), F.col("round_id") % 4))
    return folds.tower_histories(t)


@query()
def walk_forward(spark, sf_dir):
    """Strict walk-forward test of a mixed forecaster beside the fair baseline."""
    s = ordered.carried(by_target(spark, sf_dir, (5, 10, 20)), "last", F.when(F.col("hit"), F.col("idx")), ("target",))
    s = ordered.framed(s, 0, 8, lambda rows: {"top": F.max("multiplier").over(rows(1, 8))}, ("target",))
    gap = F.col("idx") - F.coalesce("last", F.lit(-1))
    f = s.select("target", "idx", gap.alias("gap"), F.coalesce(F.col("top") >= F.col("target"), F.lit(False)).cast("int").alias("ahead"))
    return folds.walk_forward(f)


@query()
def oracle_replay(spark, sf_dir):
    """Locks resolved one after the other, as they would have been made live."""
    r = rounds(spark, sf_dir).select("round_id", "multiplier")
    hits = r.crossJoin(param(spark, "target int", list(ORACLE_WINDOWS))).where("multiplier >= target").select("target", "round_id")
    now = F.broadcast(r.agg(F.max("round_id").alias("now")))
    return folds.replay(hits, now, ORACLE_WINDOWS)


@query()
def lock_cycle(spark, sf_dir):
    """Newest lock of each target, resolved and followed by its next generation:
    windows are the geometric quantile around the median known gap."""
    r = rounds(spark, sf_dir).select("round_id", "multiplier")
    hits = r.crossJoin(param(spark, "target int", list(SPANS))).where("multiplier >= target").select("target", "round_id")
    done = folds.replay(hits, F.broadcast(r.agg(F.max("round_id").alias("now"))), SPANS)
    return done.groupBy("target").agg(F.max_by(F.struct("generation", "made", "lo", "hi", "outcome"), F.struct("made", "lo")).alias("x"), F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses")).select("target", "x.*", "wins", "losses")


_SPANS = ", ".join(f"({t}, {n})" for t, n in SPANS.items())


@query(f"""WITH h AS ({ORACLES["hazard_curve"]}), g AS ({ORACLES["gap_pressure"]}), sp(target, span) AS (VALUES {_SPANS}),
p AS (SELECT g.target, span, greatest(0.00005, least(0.62, hazard * (1 + 0.38 * soft + 0.75 * hard))) AS p FROM h JOIN g ON h.target = g.target AND h.gap = least(since, 60) JOIN sp ON sp.target = g.target),
w AS (SELECT *, greatest(1.0, ln(0.8) / ln(1 - p)) AS q20, greatest(1.0, ln(0.5) / ln(1 - p)) AS q50, greatest(1.0, ln(1 - 0.8) / ln(1 - p)) AS q80 FROM p),
v AS (SELECT target, p, q50, 'fixed' AS variant, span FROM w UNION ALL SELECT target, p, q50, 'adaptive_span', greatest(span, least(3 * span, ceil((q80 - q20) / 2))) FROM w)
SELECT target, round(p, 6) AS p_hit1, round(q50, 3) AS q50, variant, CAST(greatest(1, floor(q50 - span / 2)) AS BIGINT) AS from_now, CAST(span AS BIGINT) AS span FROM v""")
def locked_windows(spark, sf_dir):
    """Windows of fixed and of adaptive span around the hazard's median wait."""
    targets = (5, 10, 50)
    hazard = prob.hazard_curve(spark, sf_dir)
    g = prob.since(spark, sf_dir, targets)
    at = hazard.join(F.broadcast(g), "target").where(F.col("gap") == F.least(F.col("since"), F.lit(60)))
    pressure = prob.gap_pressure(spark, sf_dir).select("target", "soft", "hard", "q75", "q90")
    s = at.join(F.broadcast(pressure), "target").join(param(spark, "target int, span int", SPANS.items()), "target")
    p = F.greatest(F.lit(0.00005), F.least(F.lit(0.62), F.col("hazard") * (1 + 0.38 * F.col("soft") + 0.75 * F.col("hard"))))
    wait = lambda q: F.greatest(F.lit(1.0), F.ln(F.lit(1 - q)) / F.ln(1 - F.col("p")))
    s = s.withColumn("p", p).withColumns({"q20": wait(0.2), "q50": wait(0.5), "q80": wait(0.8)})
    wide = F.greatest(F.col("span"), F.least(3 * F.col("span"), F.ceil((F.col("q80") - F.col("q20")) / 2)))
    make = lambda name, span: F.struct(F.lit(name).alias("variant"), F.greatest(F.lit(1), F.floor(F.col("q50") - span / 2)).alias("from_now"), span.cast("long").alias("span"))
    return s.select("target", F.round("p", 6).alias("p_hit1"), F.round("q50", 3).alias("q50"), F.explode(F.array(make("fixed", F.col("span")), make("adaptive_span", wide))).alias("x")).select("target", "p_hit1", "q50", "x.*")


#: Rows below which the report has only what needs no model.
WARM = 200
_REPORT = (
    ("buckets", "bucket_probs_closed", "name", "probability"), ("recent", "threshold_snapshot", "target", "recent"), ("fair", "threshold_snapshot", "target", "fair"),
    ("value", "threshold_snapshot", "target", "ev"), ("pressure", "gap_pressure", "target", "hard"), ("soft_pressure", "gap_pressure", "target", "soft"),
    *[("trend", "trend_context", f"'{k}'", k) for k in ("short", "long", "trend", "vol")], ("analogues", "analogues_weighted", "'p_hit5'", "p_hit5"), ("analogues", "analogues_weighted", "'n'", "n"),
)
_ALWAYS = ("buckets", "recent", "fair", "value")
_REPORT_SQL = " UNION ALL ".join(f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, CAST({value} AS DOUBLE) AS value FROM ({ORACLES[name]})" for section, name, key, value in _REPORT)


@query(f"""WITH r AS ({_REPORT_SQL}), n AS (SELECT count(*) AS n FROM events) SELECT section, key, value FROM r, n WHERE n >= {WARM} OR section IN {_ALWAYS}
UNION ALL SELECT 'status', 'ready', CAST(n >= {WARM} AS INT)::DOUBLE FROM n""")
def next_round_report(spark, sf_dir):
    """Section, key, value: the parts of the next-round report in long form. Under
    WARM rows only rates are there, and status says so."""
    plans = {"bucket_probs_closed": statistics.bucket_probs_closed, "threshold_snapshot": statistics.threshold_snapshot, "gap_pressure": prob.gap_pressure, "trend_context": sequences.trend_context, "analogues_weighted": analogues_weighted}
    n = F.broadcast(rounds(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")))
    out = n.select(F.lit("status").alias("section"), F.lit("ready").alias("key"), (F.col("n") >= WARM).cast("int").cast("double").alias("value"))
    cells: dict[str, list] = {}
    for section, name, key, value in _REPORT:
        named = F.lit(key.strip("'")) if key.startswith("'") else F.col(key).cast("string")
        cells.setdefault(name, []).append(F.struct(F.lit(section).alias("section"), named.alias("key"), F.col(value).cast("double").alias("value")))
    for name, parts in cells.items():  # each part is computed once, whatever sections it has
        made = plans[name](spark, sf_dir).select(F.explode(F.array(*parts)).alias("x")).select("x.*")
        warm = F.col("section").isin(*_ALWAYS) | (F.col("n") >= WARM)
        out = out.unionByName(made.crossJoin(n).where(warm).drop("n"))
    return out


@query(f"WITH {R}, c(target, style) AS (VALUES (2, 'safe'), (3, 'safe'), (5, 'balanced'), (10, 'balanced'), (20, 'aggressive'), (50, 'aggressive')), p AS (SELECT target, style, avg((multiplier >= target)::INT) AS p FROM rounds, c GROUP BY ALL) SELECT style, first(target ORDER BY round(p * target, 9) DESC, target) AS target, round(max(round(p * target, 9)) - 1, 6) AS ev FROM p GROUP BY style")
def ev_table(spark, sf_dir):
    """The candidate of each style with the best value at the observed rate."""
    styles = ((2, "safe"), (3, "safe"), (5, "balanced"), (10, "balanced"), (20, "aggressive"), (50, "aggressive"))
    one = rounds(spark, sf_dir).agg(*[F.avg((F.col("multiplier") >= t).cast("int")).alias(f"p{t}") for t, _ in styles])
    p = one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(s).alias("style"), F.round(F.col(f"p{t}") * t, 9).alias("v")) for t, s in styles])).alias("x")).select("x.*")
    return p.groupBy("style").agg(F.max_by("target", F.struct("v", -F.col("target"))).alias("target"), F.round(F.max("v") - 1, 6).alias("ev"))


@query(f"""WITH s AS ({ORACLES["threshold_snapshot"]}), l AS ({ORACLES["lag1_corr"]}),
e AS (SELECT s.target, recent, fair, ev, coalesce(lag1 > 0.18, false) AS clustered, CASE WHEN s.target <= 10 THEN 0.04 WHEN s.target <= 20 THEN 0.02 ELSE 0.0 END AS gate FROM s LEFT JOIN l USING (target))
SELECT target, recent, fair, round(ev - CASE WHEN clustered THEN 0.03 ELSE 0.0 END, 9) AS ev, CASE WHEN clustered THEN 'CLUSTERED' ELSE 'RANDOM' END AS regime, ev - CASE WHEN clustered THEN 0.03 ELSE 0.0 END > gate AS open FROM e""")
def edge_gates(spark, sf_dir):
    """Per target, whether the value at the recent rate passes its gate."""
    gate = F.when(F.col("target") <= 10, 0.04).when(F.col("target") <= 20, 0.02).otherwise(0.0)
    lag = F.broadcast(sequences.lag1_corr(spark, sf_dir))
    s = statistics.threshold_snapshot(spark, sf_dir).join(lag, "target", "left")
    clustered = F.coalesce(F.col("lag1") > 0.18, F.lit(False))
    ev = F.col("ev") - F.when(clustered, 0.03).otherwise(0.0)
    return s.select("target", "recent", "fair", F.round(ev, 9).alias("ev"), F.when(clustered, "CLUSTERED").otherwise("RANDOM").alias("regime"), (ev > gate).alias("open"))

