"""Probability models over gaps, tokens and buckets, and similarity search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundwise.catalog import query
from roundwise.functions.expressions import bucket_half_open, token
from roundwise.functions.params import ORACLE_WINDOWS
from roundwise.operators import ordered, similarity
from roundwise.plans.fixtures import R, param, rounds
from roundwise.plans.sequences import TOKEN, I, by_target, sequence

G = f"{I}, t(target) AS (VALUES (5), (10), (50)), gaps AS (SELECT * FROM (SELECT target, round_id, round_id - lag(round_id) OVER (PARTITION BY target ORDER BY idx) AS gap FROM i, t WHERE multiplier >= target) WHERE gap IS NOT NULL), since AS (SELECT target, (SELECT max(round_id) FROM i) - max(round_id) AS since FROM i, t WHERE multiplier >= target GROUP BY target)"


def gaps(spark, sf_dir, targets=(5, 10, 50)) -> DataFrame:
    """target, gap: distances in ids between hits."""
    c = ordered.carried(by_target(spark, sf_dir, targets), "last", F.when(F.col("hit"), F.col("round_id")), ("target",), inclusive=False)
    return c.where("hit AND last IS NOT NULL").select("target", (F.col("round_id") - F.col("last")).alias("gap"))


def since(spark, sf_dir, targets=(5, 10, 50)) -> DataFrame:
    """target, since: ids since the last hit. A row a target."""
    r = rounds(spark, sf_dir)
    one = r.agg(F.max("round_id").alias("now"), *[F.max(F.when(F.col("multiplier") >= t, F.col("round_id"))).alias(f"h{t}") for t in targets])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), (F.col("now") - F.col(f"h{t}")).alias("since")) for t in targets])).alias("x")).select("x.*")


def tally(spark, sf_dir) -> DataFrame:
    """target, gap, n: how often each gap occurs; all that follows starts here,
    so sizes depend on distinct gaps, not on rounds."""
    return gaps(spark, sf_dir).groupBy("target", "gap").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {G}, k AS (SELECT unnest([1, 2, 3, 5, 8, 13, 21, 34, 55, 89]) AS t) SELECT target, t, round(avg((gap > t)::INT), 9) AS survival FROM gaps, k GROUP BY ALL")
def survival_curve(spark, sf_dir):
    """Share of gaps beyond t: without censoring the product-limit estimate."""
    steps = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
    s = tally(spark, sf_dir).groupBy("target").agg(F.array(*[F.struct(F.lit(t).alias("t"), F.round(F.sum(F.when(F.col("gap") > t, F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("survival")) for t in steps]).alias("s"))
    return s.select("target", F.explode("s").alias("x")).select("target", "x.*")


@query(f"WITH {G}, w(target, k) AS (VALUES (5, 4), (10, 6), (50, 20)), c AS (SELECT g.target, k, since, count(*) AS n, count(*) FILTER (WHERE gap > least(since, (SELECT max(gap) + 120 FROM gaps x WHERE x.target = g.target))) AS a, count(*) FILTER (WHERE gap > since + k) AS b FROM gaps g JOIN since USING (target) JOIN w USING (target) GROUP BY ALL) SELECT target, since, round(CASE WHEN a = 0 THEN 100.0 ELSE (1 - b / a::DOUBLE) * 100 END, 6) AS p_hit FROM c")
def km_hit_probability(spark, sf_dir):
    """Probability of a hit within the window, given the gap so far."""
    w = param(spark, "target int, k int", [(t, ORACLE_WINDOWS[t]) for t in (5, 10, 50)])
    g = tally(spark, sf_dir).join(F.broadcast(since(spark, sf_dir)), "target").join(w, "target")
    beyond = lambda c: F.sum(F.when(F.col("gap") > c, F.col("n")).otherwise(0))
    c = g.groupBy("target", "since").agg(beyond(F.col("since")).alias("a"), beyond(F.col("since") + F.col("k")).alias("b"))
    return c.select("target", "since", F.round(F.when(F.col("a") == 0, 100.0).otherwise((1 - F.col("b") / F.nullif(F.col("a"), F.lit(0))) * 100), 6).alias("p_hit"))


HAZ = f"{I}, t(target) AS (VALUES (5), (10), (50)), s AS (SELECT target, idx, idx - coalesce(max(CASE WHEN multiplier >= target THEN idx END) OVER (PARTITION BY target ORDER BY idx), -1) AS gap, lead(multiplier) OVER (PARTITION BY target ORDER BY idx) >= target AS hit FROM i, t), o AS (SELECT target, least(gap, 60) AS g, count(*) AS o, sum(hit::INT) AS h FROM s WHERE hit IS NOT NULL GROUP BY ALL), a AS (SELECT target, sum(h) / sum(o)::DOUBLE AS p FROM o GROUP BY target)"


@query(f"WITH {HAZ}, g AS (SELECT target, unnest(range(61)) AS g, p FROM a), k AS (SELECT g.target, g.g, g.p, sum(coalesce(o.o, 0) * CASE abs(o.g - g.g) WHEN 0 THEN 1.8 WHEN 1 THEN 1.1 ELSE 0.6 END) AS o, sum(coalesce(o.h, 0) * CASE abs(o.g - g.g) WHEN 0 THEN 1.8 WHEN 1 THEN 1.1 ELSE 0.6 END) AS h FROM g LEFT JOIN o ON o.target = g.target AND abs(o.g - g.g) <= 2 GROUP BY ALL) SELECT target, g AS gap, round(greatest(0.000001, least(0.95, (coalesce(h, 0) + 8 * p) / (coalesce(o, 0) + 8))), 9) AS hazard FROM k")
def hazard_curve(spark, sf_dir):
    """Smoothed hazard by the running gap (cut at 60): a five-step kernel, shrunk
    to the overall rate. The curve is 61 rows a target."""
    c = ordered.carried(by_target(spark, sf_dir), "last", F.when(F.col("hit"), F.col("idx")), ("target",))
    c = ordered.framed(c, 0, 1, lambda rows: {"next": F.max("multiplier").over(rows(1, 1))}, ("target",)).where("next IS NOT NULL")
    o = c.groupBy("target", F.least(F.lit(60), F.col("idx") - F.coalesce("last", F.lit(-1))).alias("g")).agg(F.count(F.lit(1)).alias("o"), F.count_if(F.col("next") >= F.col("target")).alias("h"))
    every = o.groupBy("target").agg((F.sum("h") / F.sum("o")).alias("p")).select("target", "p", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("g"))
    near = Window.partitionBy("target").orderBy("g")
    grid = every.join(o, ["target", "g"], "left").fillna(0, ["o", "h"])
    kernel = lambda c: sum((F.coalesce(F.lag(c, d).over(near), F.lit(0)) + F.coalesce(F.lead(c, d).over(near), F.lit(0))) * w for d, w in ((1, 1.1), (2, 0.6))) + F.col(c) * 1.8
    hazard = (kernel("h") + 8 * F.col("p")) / (kernel("o") + 8)
    return grid.select("target", F.col("g").alias("gap"), F.round(F.greatest(F.lit(0.000001), F.least(F.lit(0.95), hazard)), 9).alias("hazard"))


@query(f"WITH {I}, s AS (SELECT idx, {TOKEN} AS token, lag({TOKEN}) OVER (ORDER BY idx) AS p1, lag({TOKEN}, 2) OVER (ORDER BY idx) AS p2 FROM i), two AS (SELECT p2, p1, count(*) AS n2, avg((token >= 5)::INT) AS r2 FROM s WHERE p2 IS NOT NULL GROUP BY ALL), one AS (SELECT p1, count(*) AS n1, avg((token >= 5)::INT) AS r1 FROM s WHERE p1 IS NOT NULL GROUP BY ALL) SELECT p2, p1, n2 AS support, round(CASE WHEN n2 >= 20 THEN r2 WHEN n1 >= 20 THEN r1 ELSE 4 / 9.0 END, 9) AS p_high FROM two JOIN one USING (p1)")
def markov_next(spark, sf_dir):
    """Chance of a token of 5 or more after two tokens, backing off to one token
    and then to uniform while support is under 20."""
    s = sequence(spark, sf_dir).withColumn("token", token(F.col("multiplier")))
    s = ordered.framed(s, 2, 0, lambda rows: {"p1": F.max("token").over(rows(-1, -1)), "p2": F.max("token").over(rows(-2, -2))})
    high = (F.col("token") >= 5).cast("int")
    pairs = s.where("p1 IS NOT NULL").groupBy("p2", "p1").agg(F.count(F.lit(1)).alias("n"), F.sum(high).alias("h"))  # at most 90 rows
    one = pairs.groupBy("p1").agg(F.sum("n").alias("n1"), F.sum("h").alias("h1"))
    two = pairs.where("p2 IS NOT NULL").join(F.broadcast(one), "p1")
    p = F.when(F.col("n") >= 20, F.col("h") / F.col("n")).when(F.col("n1") >= 20, F.col("h1") / F.col("n1")).otherwise(4 / 9.0)
    return two.select("p2", "p1", F.col("n").alias("support"), F.round(p, 9).alias("p_high"))


@query(f"WITH {G}, q AS (SELECT target, quantile_cont(gap, 0.75) AS q75, quantile_cont(gap, 0.9) AS q90 FROM gaps GROUP BY target) SELECT target, since, q75, q90, round(greatest(0, least(1, (since - q75) / greatest(2, q90 - q75 + 1))), 9) AS soft, round(greatest(0, least(1, (since - q90) / greatest(3, 0.35 * q90 + 2))), 9) AS hard FROM q JOIN since USING (target)")
def gap_pressure(spark, sf_dir):
    q = gaps(spark, sf_dir).groupBy("target").agg(F.percentile("gap", F.array(F.lit(0.75), F.lit(0.9))).alias("q")).select("target", F.col("q")[0].alias("q75"), F.col("q")[1].alias("q90"))
    part = lambda a, b: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / b)), 9)
    return q.join(F.broadcast(since(spark, sf_dir)), "target").select("target", "since", "q75", "q90", part(F.col("since") - F.col("q75"), F.greatest(F.lit(2.0), F.col("q90") - F.col("q75") + 1)).alias("soft"), part(F.col("since") - F.col("q90"), F.greatest(F.lit(3.0), 0.35 * F.col("q90") + 2)).alias("hard"))


@query(f"WITH {R}, c AS (SELECT CASE WHEN multiplier >= 25 THEN 4 WHEN multiplier >= 10 THEN 3 WHEN multiplier >= 5 THEN 2 WHEN multiplier >= 2 THEN 1 ELSE 0 END AS bucket, count(*) AS n FROM rounds GROUP BY 1) SELECT bucket, round(sum(n) OVER (ORDER BY bucket DESC) / sum(n) OVER ()::DOUBLE, 9) AS exceedance FROM c")
def exceedance(spark, sf_dir):
    """Chance to reach each bucket: a running sum over five rows."""
    c = rounds(spark, sf_dir).groupBy(bucket_half_open(F.col("multiplier")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("bucket")))
    return c.select("bucket", F.round(above / F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 9).alias("exceedance"))


@query(f"WITH {I}, s AS (SELECT idx, multiplier < 2 AS low, idx - coalesce(max(CASE WHEN multiplier >= 2 THEN idx END) OVER (ORDER BY idx), -1) AS run, lead(multiplier) OVER (ORDER BY idx) AS next FROM i) SELECT least(run, 40) AS run, count(*) AS n, round(avg((next < 2)::INT), 9) AS continues, round(avg((next >= 5)::INT), 9) AS rebounds FROM s WHERE low AND next IS NOT NULL GROUP BY 1 HAVING count(*) >= 8")
def white_transitions(spark, sf_dir):
    """How runs below 2 go on, by their length."""
    s = ordered.runs(sequence(spark, sf_dir), "run", F.col("multiplier") < 2)
    s = ordered.framed(s, 0, 1, lambda rows: {"next": F.max("multiplier").over(rows(1, 1))}).where("run > 0 AND next IS NOT NULL")
    t = s.groupBy(F.least(F.col("run"), F.lit(40)).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("next") < 2).cast("int")), 9).alias("continues"), F.round(F.avg((F.col("next") >= 5).cast("int")), 9).alias("rebounds"))
    return t.where("n >= 8")


@query(f"WITH {G}, f AS (SELECT target, quantile_cont(gap, 0.25) AS q1, quantile_cont(gap, 0.75) AS q3 FROM gaps GROUP BY target), k AS (SELECT g.target, gap FROM gaps g JOIN f USING (target) WHERE gap BETWEEN q1 - 1.5 * greatest(1, q3 - q1) AND q3 + 1.5 * greatest(1, q3 - q1)), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY gap) - 1 AS rn, count(*) OVER (PARTITION BY target) AS n FROM k), w AS (SELECT * FROM r WHERE n < 12 OR (rn >= floor(n * 0.1) AND rn < n - floor(n * 0.1))) SELECT target, count(*) AS n, min(gap) AS low, max(gap) AS high, quantile_cont(gap, 0.5) AS med, quantile_cont(gap, 0.9) AS p90, round(avg(gap), 6) AS mean FROM w GROUP BY target")
def robust_gap_stats(spark, sf_dir):
    """Gaps inside the Tukey fence, a tenth trimmed at both ends. Ranks come from
    cumulative counts of distinct gaps."""
    g = tally(spark, sf_dir)
    fence = g.groupBy("target").agg(F.percentile("gap", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"))
    span = F.greatest(F.lit(1.0), F.col("q")[1] - F.col("q")[0])
    k = g.join(F.broadcast(fence), "target").where((F.col("gap") >= F.col("q")[0] - 1.5 * span) & (F.col("gap") <= F.col("q")[1] + 1.5 * span))
    w = Window.partitionBy("target")
    upto, whole = F.sum("n").over(w.orderBy("gap")), F.sum("n").over(w)
    k = k.select("target", "gap", "n", upto.alias("upto"), whole.alias("whole"))
    cut = F.when(F.col("whole") < 12, 0).otherwise(F.floor(F.col("whole") * 0.1))
    left = F.greatest(F.lit(0), F.least("upto", F.col("whole") - cut) - F.greatest(F.col("upto") - F.col("n"), cut))
    k = k.withColumn("kept", left).where("kept > 0")
    s = k.groupBy("target").agg(F.sum("kept").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.percentile("gap", F.array(F.lit(0.5), F.lit(0.9)), F.col("kept")).alias("q"), F.round(F.sum(F.col("gap") * F.col("kept")) / F.sum("kept"), 6).alias("mean"))
    return s.select("target", "n", "low", "high", F.col("q")[0].alias("med"), F.col("q")[1].alias("p90"), "mean")


@query(f"WITH {G}, s AS (SELECT target, gap, since, row_number() OVER (PARTITION BY target ORDER BY gap) - 1 AS rn, count(*) OVER (PARTITION BY target) AS n FROM gaps JOIN since USING (target) WHERE gap > since) SELECT target, count(*) AS n, greatest(min(since) + 1, CAST(floor(avg(gap) + 0.5) AS BIGINT)) AS expected FROM s WHERE n < 12 OR (rn >= floor(n * 0.1) AND rn < n - floor(n * 0.1)) GROUP BY target")
def conditional_gap(spark, sf_dir):
    """Trimmed mean of the gaps longer than the present one."""
    k = tally(spark, sf_dir).join(F.broadcast(since(spark, sf_dir)), "target").where("gap > since")
    w = Window.partitionBy("target")
    k = k.withColumns({"upto": F.sum("n").over(w.orderBy("gap")), "whole": F.sum("n").over(w)})
    cut = F.when(F.col("whole") < 12, 0).otherwise(F.floor(F.col("whole") * 0.1))
    k = k.withColumn("kept", F.greatest(F.lit(0), F.least("upto", F.col("whole") - cut) - F.greatest(F.col("upto") - F.col("n"), cut)))
    s = k.groupBy("target").agg(F.sum("kept").alias("n"), F.max("since").alias("since"), (F.sum(F.col("gap") * F.col("kept")) / F.sum("kept")).alias("mean"))
    return s.select("target", "n", F.greatest(F.col("since") + 1, F.floor(F.col("mean") + 0.5)).alias("expected"))


@query(f"WITH {G}, b AS (SELECT target, min(gap) AS low, greatest(min(gap), max(gap) - 6 + 1) AS high, count(*) AS n FROM gaps GROUP BY target), st AS (SELECT target, n, unnest(range(low, high + 1)) AS start FROM b), r AS (SELECT st.target, st.start, st.n, count(g.gap) * 100.0 / st.n AS rate FROM st LEFT JOIN gaps g ON g.target = st.target AND g.gap BETWEEN st.start AND st.start + 5 GROUP BY st.target, st.start, st.n) SELECT target, round(avg(rate), 6) AS rate, round(coalesce(stddev_samp(rate), 0), 6) AS spread FROM r GROUP BY target")
def chance_rate(spark, sf_dir):
    """Share of gaps in a window of six, over all starts: each distinct gap adds
    to the six starts before it, so no start meets all gaps."""
    g = tally(spark, sf_dir)
    ends = g.groupBy("target").agg(F.min("gap").alias("low"), F.greatest(F.min("gap"), F.max("gap") - 5).alias("high"), F.sum("n").alias("total"))
    starts = ends.select("target", "total", F.explode(F.sequence("low", "high")).alias("start"))
    seen = g.select("target", "n", F.explode(F.sequence(F.col("gap") - 5, F.col("gap"))).alias("start")).groupBy("target", "start").agg(F.sum("n").alias("n"))
    rate = F.coalesce("n", F.lit(0)) * 100.0 / F.col("total")
    return starts.join(seen, ["target", "start"], "left").groupBy("target").agg(F.round(F.avg(rate), 6).alias("rate"), F.round(F.coalesce(F.stddev_samp(rate), F.lit(0.0)), 6).alias("spread"))


@query(f"WITH {G}, b AS (SELECT target, gap // 8 AS bin, count(*) AS n FROM gaps GROUP BY ALL), e AS (SELECT target, unnest(range(0, max(bin) + 1)) AS bin FROM b GROUP BY target), f AS (SELECT e.target, e.bin, coalesce(n, 0) AS n FROM e LEFT JOIN b USING (target, bin)), s AS (SELECT *, round((n + 0.55 * (coalesce(lag(n) OVER w, 0) + coalesce(lead(n) OVER w, 0)))::DOUBLE, 6) AS smooth FROM f WINDOW w AS (PARTITION BY target ORDER BY bin)) SELECT target, bin, n, smooth, coalesce(smooth >= lag(smooth) OVER w, true) AND coalesce(smooth > lead(smooth) OVER w, true) AS peak FROM s WINDOW w AS (PARTITION BY target ORDER BY bin)")
def gap_histogram(spark, sf_dir):
    """Smoothed histogram with its peaks; empty bins are there."""
    b = tally(spark, sf_dir).groupBy("target", F.floor(F.col("gap") / 8).alias("bin")).agg(F.sum("n").alias("n"))
    e = b.groupBy("target").agg(F.max("bin").alias("top")).select("target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("bin"))
    w = Window.partitionBy("target").orderBy("bin")
    beside = lambda c, f: F.coalesce(f(c).over(w), F.lit(0))
    s = e.join(b, ["target", "bin"], "left").fillna(0, ["n"]).withColumn("smooth", F.round(F.col("n") + 0.55 * (beside("n", F.lag) + beside("n", F.lead)), 6))
    peak = F.coalesce(F.col("smooth") >= F.lag("smooth").over(w), F.lit(True)) & F.coalesce(F.col("smooth") > F.lead("smooth").over(w), F.lit(True))
    return s.select("target", "bin", "n", "smooth", peak.alias("peak"))


@query("WITH t(target) AS (VALUES (5), (10), (20), (50), (100)), q(q) AS (VALUES (0.25), (0.5), (0.75)) SELECT target, q::DOUBLE AS q, CAST(ceil(round(ln(1 - q) / ln(1 - 1.0 / target), 9)) AS BIGINT) AS rounds FROM t, q")
def geometric_band(spark, sf_dir):
    """Quantiles of the wait for a hit under the fair rate."""
    t = param(spark, "target int", (5, 10, 20, 50, 100)).crossJoin(param(spark, "q double", (0.25, 0.5, 0.75)))
    return t.select("target", "q", F.ceil(F.round(F.ln(1 - F.col("q")) / F.ln(1 - 1.0 / F.col("target")), 9)).alias("rounds"))


@query(f"WITH {R}, t(target) AS (VALUES (5), (10), (20), (50)), p AS (SELECT target, avg((multiplier >= target)::INT) AS p FROM rounds, t GROUP BY target) SELECT target, round(p, 9) AS p, round(p * target - 1, 9) AS ev, round(greatest(0, least(0.15, (p * target - 1) / (target - 1) * 0.8)), 9) AS stake FROM p")
def kelly(spark, sf_dir):
    """Kelly fraction at a confidence of 0.8, cut at 0.15, beside its value."""
    targets = (5, 10, 20, 50)
    one = rounds(spark, sf_dir).agg(*[F.avg((F.col("multiplier") >= t).cast("int")).alias(f"p{t}") for t in targets])
    p = one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"p{t}").alias("p")) for t in targets])).alias("x")).select("x.*")
    ev = F.col("p") * F.col("target") - 1
    return p.select("target", F.round("p", 9).alias("p"), F.round(ev, 9).alias("ev"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.15), ev / (F.col("target") - 1) * 0.8)), 9).alias("stake"))


ANALOG = f"{I}, n AS (SELECT count(*) AS n FROM i), x AS (SELECT idx, ln(multiplier) AS x, multiplier FROM i), cur AS (SELECT list(x ORDER BY idx) AS c FROM x, n WHERE idx >= n - 10), w AS (SELECT idx AS start, list(x) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS v, max(multiplier) OVER (ORDER BY idx ROWS BETWEEN 10 FOLLOWING AND 15 FOLLOWING) >= 10 AS hit FROM x), d AS (SELECT start, hit, round(list_sum(list_transform(range(1, 11), lambda j: abs(v[j] - c[j]))) / 10, 9) AS distance FROM w, cur, n WHERE start <= n - 10 - 10 - 6)"


@query(f"WITH {ANALOG} SELECT start, distance, hit FROM d ORDER BY distance, start LIMIT 24")
def analogues_oracle(spark, sf_dir):
    """The 24 stretches of ten rounds most like the last ten, by mean absolute
    log difference, and whether 10x followed within six."""
    return similarity.analogues(sequence(spark, sf_dir), length=10, window=6, target=10.0, k=24)


@query(f"WITH {I}, b AS (SELECT source_key, CASE WHEN multiplier >= 25 THEN 4 WHEN multiplier >= 10 THEN 3 WHEN multiplier >= 5 THEN 2 WHEN multiplier >= 2 THEN 1 ELSE 0 END AS bucket, count(*)::DOUBLE AS n FROM i GROUP BY ALL), p AS (SELECT a.source_key AS a, b.source_key AS b, sum(a.n * b.n) AS dot FROM b a JOIN b ON a.bucket = b.bucket GROUP BY ALL) SELECT p.a, p.b, round(p.dot / sqrt(x.dot * y.dot), 9) AS cosine FROM p JOIN p x ON x.a = p.a AND x.b = p.a JOIN p y ON y.a = p.b AND y.b = p.b WHERE p.a < p.b")
def cosine_buckets(spark, sf_dir):
    """Cosine of the bucket counts of each two sources: a vector a source first."""
    return similarity.cosine_pairs(rounds(spark, sf_dir).groupBy("source_key").agg(F.array(*[F.count_if(bucket_half_open(F.col("multiplier")) == b).cast("double") for b in range(5)]).alias("v")))


@query("WITH v AS (SELECT vec_id, label, embedding FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance FROM q JOIN v ON v.vec_id <> q.vec_id) SELECT query_id, vec_id, distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10")
def nearest_vectors(spark, sf_dir):
    """Exact nearest neighbours, among all rows, of every row whose id is divisible by 20."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return similarity.nearest(v.where("vec_id % 20 = 0"), v, k=10)
