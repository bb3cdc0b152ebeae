"""The ledger of forecasts: resolution, merges, summaries and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roundwise.catalog import query
from roundwise.functions.expressions import outcome, safe_div
from roundwise.functions.params import SPANS
from roundwise.operators import joins, ordered
from roundwise.plans.fixtures import LOCKS, R, locks, param, rounds
from roundwise.plans.scans import LEDGER, ledger
from roundwise.sources import merges


@query(f"WITH {R}, {LEDGER}, n AS (SELECT max(round_id) AS now FROM rounds) SELECT target, made, CASE WHEN hit < lo THEN 'early' WHEN hit <= hi THEN 'win' WHEN lo <= made OR now >= hi THEN 'loss' WHEN now >= lo THEN 'window-open' ELSE 'pending' END AS status, hit FROM ledger, n")
def lock_resolution(spark, sf_dir):
    """Status of each lock as of the newest round; a loss is known at hi."""
    now = rounds(spark, sf_dir).agg(F.max("round_id").alias("now"))
    status = F.when(F.col("hit") < F.col("lo"), "early").when(F.col("hit") <= F.col("hi"), "win").when((F.col("lo") <= F.col("made")) | (F.col("now") >= F.col("hi")), "loss").when(F.col("now") >= F.col("lo"), "window-open").otherwise("pending")
    return ledger(spark, sf_dir).crossJoin(F.broadcast(now)).select("target", "made", status.alias("status"), "hit")


@query(f"WITH {R}, {LOCKS} SELECT l.target, l.made, (SELECT min(r.round_id) FROM rounds r WHERE r.multiplier >= l.target AND r.round_id > l.hi) AS hit FROM locks l WHERE l.target <= 50")
def first_hit_after(spark, sf_dir):
    """First hit after the window, however far."""
    asked = locks(spark, sf_dir).where("target <= 50").select("target", "made", "hi")
    return joins.next_hit(asked, rounds(spark, sf_dir), after="hi").select("target", "made", "hit")


@query(f"WITH {R}, {LEDGER}, c AS (SELECT target, made, span, hi, hi + greatest(12 * span, 100) AS cap FROM ledger WHERE outcome = 'loss'), f AS (SELECT c.target, c.made, min(r.round_id) AS hit FROM c JOIN rounds r ON r.multiplier >= c.target AND r.round_id > c.hi AND r.round_id <= c.cap GROUP BY ALL) SELECT c.target, c.made, f.hit, CASE WHEN f.hit IS NULL THEN 1.0 ELSE (f.hit - c.hi) / c.span::DOUBLE END AS error FROM c LEFT JOIN f USING (target, made)")
def loss_error(spark, sf_dir):
    """How late the hit of a lost lock came, in spans, searched up to a cap;
    1 if there was none."""
    lost = ledger(spark, sf_dir).where("outcome = 'loss'").select("target", "made", "span", "hi")
    found = joins.first_hit(lost, rounds(spark, sf_dir), F.col("hi") + F.greatest(12 * F.col("span"), F.lit(100)), after="hi")
    return found.select("target", "made", "hit", F.when(F.col("hit").isNull(), 1.0).otherwise((F.col("hit") - F.col("hi")) / F.col("span")).alias("error"))


@query(f"WITH {R}, {LOCKS}, a AS (SELECT target, max(lo) AS lo FROM locks WHERE made <= 500 AND target <> 5 GROUP BY target), b AS (SELECT target, max(lo) AS lo FROM locks WHERE made <= CASE WHEN target = 50 THEN 500 ELSE 600 END AND target <> 1000 GROUP BY target) SELECT coalesce(a.target, b.target) AS target, a.lo AS old_lo, b.lo AS new_lo, CASE WHEN a.lo IS NULL THEN 'added' WHEN b.lo IS NULL THEN 'removed' WHEN a.lo <> b.lo THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.target = b.target")
def lock_diff(spark, sf_dir):
    """Old and new locks compared by key."""
    every = locks(spark, sf_dir)
    old = every.where("made <= 500 AND target <> 5").groupBy("target").agg(F.max("lo").alias("old_lo"))
    new = every.where("made <= CASE WHEN target = 50 THEN 500 ELSE 600 END AND target <> 1000").groupBy("target").agg(F.max("lo").alias("new_lo"))
    change = F.when(F.col("old_lo").isNull(), "added").when(F.col("new_lo").isNull(), "removed").when(F.col("old_lo") != F.col("new_lo"), "changed").otherwise("same")
    return old.join(new, "target", "full").select("target", "old_lo", "new_lo", change.alias("change"))


@query(f"WITH {R}, {LEDGER} SELECT target, made, CASE WHEN hit BETWEEN lo AND hi THEN 'win' WHEN hit < lo THEN 'early' ELSE 'loss' END AS outcome, made % 3 = 0 AS repaired FROM ledger")
def outcome_repair(spark, sf_dir):
    """Stored outcomes are ignored: lo, hi and hit decide on write and read."""
    stored = ledger(spark, sf_dir).withColumn("stored", F.when(F.col("made") % 3 == 0, "unknown").otherwise(F.col("outcome")))
    fixed = outcome(F.col("lo"), F.col("hi"), F.col("hit"))
    return stored.select("target", "made", fixed.alias("outcome"), (F.col("stored") != fixed).alias("repaired"))


COUNTS = "count(outcome) AS total, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'early') AS early, count(*) FILTER (WHERE outcome = 'loss') AS losses"


@query(f"WITH {R}, {LEDGER}, f(target) AS (SELECT target FROM targets), c AS (SELECT f.target, {COUNTS} FROM f LEFT JOIN ledger USING (target) GROUP BY f.target) SELECT *, round(wins / nullif(wins + losses, 0)::DOUBLE, 9) AS accuracy FROM c")
def history_summary(spark, sf_dir):
    """Per target of the fixed list; early ones don't count for accuracy."""
    o = F.col("outcome")
    c = ledger(spark, sf_dir).groupBy("target").agg(F.count(o).alias("total"), F.count_if(o == "win").alias("wins"), F.count_if(o == "early").alias("early"), F.count_if(o == "loss").alias("losses"))
    all_ = param(spark, "target int", list(SPANS)).join(c, "target", "left").fillna(0)
    return all_.withColumn("accuracy", F.round(safe_div(F.col("wins").cast("double"), F.col("wins") + F.col("losses")), 9))


@query(f"WITH {R}, {LEDGER} SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'win') AS hits, count(*) FILTER (WHERE outcome = 'early') AS early, count(*) FILTER (WHERE outcome NOT IN ('win', 'early')) AS failed, CAST(floor(100.0 * count(*) FILTER (WHERE outcome = 'win') / count(*) + 0.5) AS BIGINT) AS percent FROM ledger")
def oracle_summary(spark, sf_dir):
    """Every outcome besides win and early is a failure; whole percents."""
    o = F.col("outcome")
    c = ledger(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(o == "win").alias("hits"), F.count_if(o == "early").alias("early"), F.count_if(~o.isin("win", "early")).alias("failed"))
    return c.withColumn("percent", F.floor(100.0 * F.col("hits") / F.col("total") + 0.5))


@query(f"WITH {R}, {LEDGER}, p AS (SELECT *, (made * 7919 % 1000) / 1000.0 AS prob FROM ledger), b AS (SELECT CAST(floor(prob * 10) * 10 AS BIGINT) AS bucket, count(*) AS n, avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) AS rate FROM p GROUP BY 1), g AS (SELECT avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END) AS rate FROM p) SELECT bucket, n, round(b.rate, 9) AS rate, round(0.62 * (bucket + 5) / 100 + 0.38 * CASE WHEN n >= 24 THEN b.rate ELSE g.rate END, 9) AS calibrated FROM b, g")
def calibration_deciles(spark, sf_dir):
    """Hit rates by decile of the stated probability; small deciles fall back to
    the overall rate."""
    p = ledger(spark, sf_dir).withColumn("prob", (F.col("made") * 7919 % 1000) / 1000.0)
    win = (F.col("outcome") == "win").cast("double")
    b = p.groupBy((F.floor(F.col("prob") * 10) * 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(win).alias("rate"))
    g = p.agg(F.avg(win).alias("all"))
    mixed = 0.62 * (F.col("bucket") + 5) / 100 + 0.38 * F.when(F.col("n") >= 24, F.col("rate")).otherwise(F.col("all"))
    return b.crossJoin(F.broadcast(g)).select("bucket", "n", F.round("rate", 9).alias("rate"), F.round(mixed, 9).alias("calibrated"))


@query(f"WITH {R}, {LEDGER}, x AS (SELECT l.*, row_number() OVER (PARTITION BY target ORDER BY made DESC) AS back, count(*) OVER (PARTITION BY target) AS n FROM ledger l), w AS (SELECT *, least(n, 320) AS k, 1 + 2 * pow((least(n, 320) - back + 1) / least(n, 320)::DOUBLE, 2) AS w, CASE outcome WHEN 'early' THEN (hit - lo) / span::DOUBLE WHEN 'loss' THEN 1.0 ELSE 0.0 END AS err FROM x WHERE back <= 320), s AS (SELECT target, count(*) AS n, sum(w * err) / sum(w) AS mean_error, sum(w * (outcome = 'loss')::INT) / sum(w) AS loss_rate, sum(w * (outcome = 'early')::INT) / sum(w) AS early_rate FROM w GROUP BY target) SELECT target, n, round(mean_error, 6) AS mean_error, round(loss_rate, 6) AS loss_rate, round(early_rate, 6) AS early_rate, round(greatest(-0.72, least(0.72, (0.62 * mean_error + 0.38 * (loss_rate - early_rate)) * least(1.0, n / 26.0))), 6) AS shift FROM s")
def calibration_map(spark, sf_dir):
    """Recency-weighted signed error and rates of the newest 320 locks of each
    target, and the shift of the window that follows. The locks of one target
    are cut to 320 before they are weighted."""
    back = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("made")))
    x = ledger(spark, sf_dir).withColumn("back", back).where("back <= 320")
    n = F.count(F.lit(1)).over(Window.partitionBy("target"))
    err = F.when(F.col("outcome") == "early", (F.col("hit") - F.col("lo")) / F.col("span")).when(F.col("outcome") == "loss", 1.0).otherwise(0.0)
    x = x.withColumn("k", n).withColumn("w", 1 + 2 * F.pow((F.col("k") - F.col("back") + 1) / F.col("k"), F.lit(2.0))).withColumn("err", err)
    share = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    s = x.groupBy("target").agg(F.count(F.lit(1)).alias("n"), share(F.col("err")).alias("m"), share((F.col("outcome") == "loss").cast("int")).alias("l"), share((F.col("outcome") == "early").cast("int")).alias("e"))
    shift = (0.62 * F.col("m") + 0.38 * (F.col("l") - F.col("e"))) * F.least(F.lit(1.0), F.col("n") / 26.0)
    return s.select("target", "n", F.round("m", 6).alias("mean_error"), F.round("l", 6).alias("loss_rate"), F.round("e", 6).alias("early_rate"), F.round(F.greatest(F.lit(-0.72), F.least(F.lit(0.72), shift)), 6).alias("shift"))


@query(f"WITH {R}, {LEDGER}, p AS (SELECT target, made, hit, max(hit) OVER (PARTITION BY target ORDER BY made ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM ledger), g AS (SELECT *, coalesce(hit > known, known IS NULL AND hit IS NOT NULL) AS newer FROM p), r AS (SELECT *, sum(newer::INT) OVER (PARTITION BY target ORDER BY made) AS era FROM g) SELECT target, made, CAST(row_number() OVER (PARTITION BY target, era ORDER BY made) AS BIGINT) AS generation FROM r")
def generation_rule(spark, sf_dir):
    """Generations count up and start at 1 again when a newer hit is known."""
    by = ("target",)
    p = ordered.indexed(ledger(spark, sf_dir).select("target", "made", "hit"), by, "made")
    p = ordered.running_max(p, "known", F.col("hit"), by, inclusive=False)
    newer = F.coalesce(F.col("hit") > F.col("known"), F.col("known").isNull() & F.col("hit").isNotNull())
    p = ordered.carried(p, "era", F.when(newer, F.col("idx")), by)
    return p.select("target", "made", (F.col("idx") - F.coalesce("era", F.lit(0)) + 1).alias("generation"))


@query(f"WITH {R}, {LEDGER}, u AS (SELECT target, made, outcome FROM ledger WHERE made > 500 UNION ALL SELECT target, made, outcome FROM ledger WHERE made <= 500) SELECT * FROM u ORDER BY made DESC, target LIMIT 60")
def union_history(spark, sf_dir):
    x = ledger(spark, sf_dir).select("target", "made", "outcome")
    return x.where("made > 500").unionByName(x.where("made <= 500")).orderBy(F.desc("made"), "target").limit(60)


SENT = f"{R}, {LEDGER}, sent AS (SELECT target, lo, hi, hit, 1 AS generation, 1 AS arrival, 'first' AS mode, 0.5 AS prob FROM ledger WHERE made % 200 = 0 UNION ALL SELECT target, lo, hi, CASE WHEN made % 300 = 0 THEN NULL ELSE hit + 1 END, 2, 2, CASE WHEN made % 400 = 0 THEN NULL ELSE 'again' END, CASE WHEN made % 600 = 0 THEN 0.25 END FROM ledger)"


@query(f"WITH {SENT}, m AS (SELECT target, lo, hi, min(hit) AS hit, max(generation) AS generation, max_by(mode, arrival) FILTER (WHERE mode IS NOT NULL) AS mode, max_by(prob, arrival) FILTER (WHERE prob IS NOT NULL)::DOUBLE AS prob FROM sent WHERE hi >= lo GROUP BY target, lo, hi) SELECT *, CASE WHEN hit BETWEEN lo AND hi THEN 'win' WHEN hit < lo THEN 'early' ELSE 'loss' END AS outcome FROM m")
def ledger_merge(spark, sf_dir):
    """Conflicts keep the least hit, the greatest generation and of the other columns
    the last value that is there; the outcome is computed again."""
    x = ledger(spark, sf_dir)
    first = x.where("made % 200 = 0").select("target", "lo", "hi", "hit", F.lit(1).alias("generation"), F.lit("first").alias("mode"), F.lit(0.5).alias("prob"))
    again = x.select("target", "lo", "hi", F.when(F.col("made") % 300 != 0, F.col("hit") + 1).alias("hit"), F.lit(2).alias("generation"), F.when(F.col("made") % 400 != 0, "again").alias("mode"), F.when(F.col("made") % 600 == 0, 0.25).alias("prob"), F.lit(2).alias("arrival"))
    return merges.merge_forecasts(first, again, ("mode", "prob"), "arrival")


@query(f"WITH {R}, {LEDGER}, n AS (SELECT max(round_id) AS now FROM rounds) SELECT target, made, lo, hi, greatest(0, lo - now) AS rounds_to_window, greatest(0, hi - now) AS rounds_left, '{{\"span\":' || span || '}}' AS detail FROM ledger, n WHERE made >= now - 400")
def lock_payload(spark, sf_dir):
    """What is shown of an active lock; its detail goes through JSON."""
    now = rounds(spark, sf_dir).agg(F.max("round_id").alias("now"))
    x = locks(spark, sf_dir).crossJoin(F.broadcast(now)).where("made >= now - 400")
    left = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("now"))
    return x.select("target", "made", "lo", "hi", left("lo").alias("rounds_to_window"), left("hi").alias("rounds_left"), F.to_json(F.struct("span")).alias("detail"))


@query(f"WITH {R}, {LEDGER}, r AS (SELECT target, outcome, CASE outcome WHEN 'win' THEN target - 1.0 ELSE -1.0 END AS pay FROM ledger) SELECT coalesce(CAST(target AS VARCHAR), 'all') AS target, count(*) AS n, round(avg((outcome = 'win')::INT), 9) AS rate, round(sum(pay), 6) AS profit FROM r GROUP BY ROLLUP (target)")
def backtest_rollup(spark, sf_dir):
    """Per target and over all, of the rule "stake one on every lock"."""
    win = F.col("outcome") == "win"
    x = ledger(spark, sf_dir).withColumn("pay", F.when(win, F.col("target") - 1.0).otherwise(-1.0))
    r = x.rollup("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(win.cast("int")), 9).alias("rate"), F.round(F.sum("pay"), 6).alias("profit"))
    return r.withColumn("target", F.coalesce(F.col("target").cast("string"), F.lit("all")))
