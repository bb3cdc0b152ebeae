"""What stands around the models: pages of rounds, polling, stored locks, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundwise.catalog import ORACLES, query
from roundwise.operators import ordered
from roundwise.plans import probabilities, statistics
from roundwise.plans.fixtures import LOCKS, R, locks, param, rounds
from roundwise.plans.ingests import MILLIS_SQL, NOW
from roundwise.plans.scans import LEDGER, ledger
from roundwise.plans.sequences import I, sequence
from roundwise.plans.streams import work_dir
from roundwise.sources import feeds, merges, schemas

# Rows of a request, of a page, and milliseconds between polls.
LEAST, DEFAULT, MOST, PAGE = 100, 5000, 25_000, 100
CALM, BACK_OFF, ERRORS = 8_000, 60_000, 5


def limit_of(text: Column, total: Column) -> Column:
    """Rows that a request asks for: all of them, or a number brought into bounds, or
    the default."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    number = F.regexp_extract(low, r"^[+-]?\d+", 0).try_cast("long")
    bounded = F.greatest(F.lit(LEAST).cast("long"), F.least(F.lit(MOST).cast("long"), number))
    return F.when(low.isin("all", "full", "max"), F.greatest(F.lit(1).cast("long"), total)).otherwise(F.coalesce(bounded, F.lit(DEFAULT).cast("long")))


@query(f"WITH n AS (SELECT count(*) AS n FROM events), a(asked) AS (VALUES ('all'), (' MAX '), ('7'), ('250'), ('99999'), ('12x'), ('x'), ('')) SELECT asked, CASE WHEN lower(trim(asked)) IN ('all', 'full', 'max') THEN greatest(1, n) ELSE coalesce(greatest({LEAST}, least({MOST}, try_cast(regexp_extract(trim(asked), '^[+-]?[0-9]+') AS BIGINT))), {DEFAULT}) END AS rows FROM a, n")
def row_limits(spark, sf_dir):
    """How many rows requests get."""
    n = F.broadcast(rounds(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")))
    return param(spark, "asked string", ["all", " MAX ", "7", "250", "99999", "12x", "x", ""]).crossJoin(n).select("asked", limit_of(F.col("asked"), F.col("n")).alias("rows"))


def page(df: DataFrame, limit: int, offset: int = 0, since: str | None = None, until: str | None = None, least_id: int | None = None, newest: bool = False) -> DataFrame:
    """A page of rounds in ascending order: filters reach the scan, and each task
    keeps no more than offset + limit rows."""
    for condition in (F.col("ts") >= F.lit(since).cast("timestamp_ntz") if since else None, F.col("ts") <= F.lit(until).cast("timestamp_ntz") if until else None, F.col("round_id") >= least_id if least_id else None):
        df = df if condition is None else df.where(condition)
    return df.orderBy(F.desc("round_id") if newest else "round_id").offset(offset).limit(limit).orderBy("round_id")


@query(f"WITH {R}, b AS (SELECT min(ts) + (max(ts) - min(ts)) / 4 AS a, min(ts) + (max(ts) - min(ts)) / 2 AS z FROM rounds), p AS (SELECT round_id, multiplier FROM rounds, b WHERE ts >= date_trunc('second', a) AND ts <= date_trunc('second', z) AND round_id >= 100 ORDER BY round_id DESC LIMIT 120 OFFSET 30) SELECT * FROM p")
def rounds_page(spark, sf_dir):
    """120 rounds after the newest 30 of those between two times, from id 100 on."""
    r = rounds(spark, sf_dir)
    a, z = r.agg(F.min("ts"), F.max("ts")).first()
    at = lambda share: str((a + (z - a) * share).replace(microsecond=0))
    return page(r, 120, 30, at(0.25), at(0.5), 100, newest=True).select("round_id", "multiplier")


@query(f"WITH {R} SELECT round_id, multiplier, epoch_us(ts) // 1000 AS timestamp FROM rounds")
def fetch_pages(spark, sf_dir):
    """Rounds as a feed delivers them: JSON pages of a hundred, newest first, written
    as files, read as texts and parsed; pages that overlap give each round once."""
    r = rounds(spark, sf_dir)
    row = F.to_json(F.struct(F.col("round_id").alias("roundId"), F.col("multiplier").alias("gameResult"), F.expr(MILLIS_SQL).alias("timestamp")))
    home = F.floor(F.col("round_id") / PAGE)
    shared = F.when((F.col("round_id") % PAGE < 3) & (home > 0), home - 1)
    rows = r.select("round_id", row.alias("row"), F.explode(F.array_compact(F.array(home, shared))).alias("page"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("round_id", "row")), asc=False), lambda x: x["row"])
    pages = rows.groupBy("page").agg(F.concat(F.lit('{"payload":['), F.array_join(listed, ","), F.lit("]}")).alias("value")).select("value")
    path = f"{work_dir(spark)}/pages"
    pages.write.text(path)
    found = feeds.normalized(spark.read.text(path).select(F.explode(feeds.rows_of(F.col("value"))).alias("row")), "row", NOW)
    return found.groupBy("round_id").agg(F.min("multiplier").alias("multiplier"), F.min("timestamp").alias("timestamp"))


def polls(spark, sf_dir) -> DataFrame:
    """A log of polls: idx, source (one of five), ok, at and the id that was seen."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select((F.col("user_id") % 5).alias("source"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("at"), F.col("event_id").alias("round_id"))
    return ordered.indexed(log, ("source",))


_POLLS = "polls AS (SELECT user_id % 5 AS source, event_type <> 'error' AS ok, ts AS at, event_id AS round_id FROM events)"


@query(f"WITH {_POLLS}, r AS (SELECT *, row_number() OVER w - 1 AS idx, coalesce(max(CASE WHEN ok THEN round_id END) OVER w, -1) AS good FROM polls WINDOW w AS (PARTITION BY source ORDER BY round_id)), e AS (SELECT source, round_id, CAST(count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY source, good ORDER BY round_id) AS BIGINT) AS errors FROM r) SELECT source, round_id, errors, CAST(CASE WHEN errors >= {ERRORS} THEN {BACK_OFF} ELSE {CALM} END AS BIGINT) AS wait_ms FROM e")
def poll_backoff(spark, sf_dir):
    """Errors in a row after each poll, and how long the collector waits then."""
    p = ordered.runs(polls(spark, sf_dir), "errors", ~F.col("ok"), ("source",))
    return p.select("source", "round_id", "errors", F.when(F.col("errors") >= ERRORS, BACK_OFF).otherwise(CALM).cast("long").alias("wait_ms"))


@query(f"WITH {_POLLS} SELECT source, count(*) AS polls, max(round_id) AS last_poll, max(CASE WHEN ok THEN round_id END) AS last_round_id, CASE WHEN max_by(ok, round_id) THEN NULL ELSE 'poll ' || max(round_id) || ' failed' END AS last_error, count(*) FILTER (WHERE NOT ok) AS errors FROM polls GROUP BY source")
def poll_status(spark, sf_dir):
    """All sources polled: an error is kept beside its source and stops no other; the
    next success clears it."""
    p = polls(spark, sf_dir)
    failed = F.concat(F.lit("poll "), F.max("round_id").cast("string"), F.lit(" failed"))
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("polls"), F.max("round_id").alias("last_poll"), F.max(F.when(F.col("ok"), F.col("round_id"))).alias("last_round_id"), F.when(~F.max_by("ok", "round_id"), failed).alias("last_error"), F.count_if(~F.col("ok")).alias("errors"))


@query(f"WITH {R}, s AS (SELECT max(round_id) AS stored FROM rounds WHERE round_id % 997 < 400), g AS (SELECT round_id, coalesce(stored, -1) AS stored FROM rounds, s) SELECT count(*) AS behind, count(DISTINCT round_id // {PAGE}) AS pages, CASE WHEN max(stored) < 0 THEN 'bootstrap' WHEN count(*) > {PAGE} THEN 'fill' ELSE 'poll' END AS mode FROM g WHERE round_id > stored")
def collector_mode(spark, sf_dir):
    """Where a restarted collector goes on: from nothing, over a gap, or as usual."""
    r = rounds(spark, sf_dir)
    stored = F.broadcast(r.where("round_id % 997 < 400").agg(F.coalesce(F.max("round_id"), F.lit(-1)).alias("stored")))
    g = r.crossJoin(stored).where("round_id > stored")
    mode = F.when(F.max("stored") < 0, "bootstrap").when(F.count(F.lit(1)) > PAGE, "fill").otherwise("poll")
    return g.agg(F.count(F.lit(1)).alias("behind"), F.count_distinct(F.floor(F.col("round_id") / PAGE)).alias("pages"), mode.alias("mode"))


@query(f"WITH {R} SELECT round_id, CAST(multiplier AS DOUBLE) AS multiplier, NULL::BIGINT AS timestamp FROM rounds WHERE round_id % 3 = 0")
def schema_migration(spark, sf_dir):
    """Rounds of an old layout (ids as texts, no times, one column too many) brought
    to the table's."""
    old = rounds(spark, sf_dir).where("round_id % 3 = 0").select(F.col("round_id").cast("string").alias("round_id"), "multiplier", F.lit("x").alias("note"))
    return schemas.conform(old, "rounds").select("round_id", F.col("multiplier").cast("double").alias("multiplier"), "timestamp")


_NEWEST = f"{R}, {LOCKS}, newest AS (SELECT target, max(made) AS made, max(lo) AS lo, max(hi) AS hi, CASE WHEN target > 20 THEN 'consensus' ELSE 'plain' END AS source FROM locks GROUP BY target)"


@query(f"WITH {_NEWEST} SELECT target, made, CASE WHEN source = 'plain' THEN lo + 1 ELSE lo END AS lo, CASE WHEN source = 'plain' THEN hi + 1 ELSE hi END AS hi, source FROM newest WHERE NOT (source = 'plain' AND target = 5)")
def lock_roundtrip(spark, sf_dir):
    """Active locks are stored as JSON state, those of one source are replaced (one
    fewer, windows moved), and all are read back."""
    at = lambda c: F.max(c).alias(c)
    newest = locks(spark, sf_dir).groupBy("target").agg(at("made"), at("lo"), at("hi"))
    state = newest.select("target", F.when(F.col("target") > 20, "consensus").otherwise("plain").alias("source"), F.to_json(F.struct("made", "lo", "hi")).alias("eta_json"))
    table = merges.Table(spark, f"{work_dir(spark)}/locks")
    table.replace(state)
    moved = newest.where("target > 5 AND target <= 20").select("target", F.lit("plain").alias("source"), F.to_json(F.struct("made", (F.col("lo") + 1).alias("lo"), (F.col("hi") + 1).alias("hi"))).alias("eta_json"))
    table.replace_where("source", "plain", moved)
    return table.read().select("target", F.from_json("eta_json", "made long, lo long, hi long").alias("x"), "source").select("target", "x.*", "source")


@query(f"WITH {R} SELECT source_key, count(*) AS n FROM rounds WHERE source_key <> 'click' GROUP BY source_key UNION ALL SELECT '(gone)', count(*) FROM rounds WHERE source_key = 'click' UNION ALL SELECT '(sites)', count(DISTINCT source_key) FROM rounds WHERE source_key <> 'click'")
def delete_by_source(spark, sf_dir):
    """A site is deleted from its table, and its rounds from theirs: what stays, and
    how many rounds went."""
    path = work_dir(spark)
    sites, stored = merges.Table(spark, f"{path}/sites"), merges.Table(spark, f"{path}/rounds")
    stored.replace(rounds(spark, sf_dir).select("round_id", "source_key"))
    sites.replace(stored.read().select("source_key").distinct())
    gone = merges.delete_cascade(sites, "source_key", "click", {stored: "source_key"})
    left = stored.read().groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    return left.unionByName(spark.createDataFrame([("(gone)", gone[stored.path]), ("(sites)", sites.read().count())], "source_key string, n long"))


@query(f"WITH s AS ({ORACLES['threshold_snapshot']}), g AS ({ORACLES['gap_pressure']}) SELECT s.target, CASE WHEN recent > 1.15 * fair THEN 'above the fair rate' WHEN recent < 0.85 * fair THEN 'below the fair rate' ELSE 'near the fair rate' END || CASE WHEN hard > 0 THEN '; gap beyond the ninth decile' WHEN soft > 0 THEN '; gap beyond the third quartile' ELSE '' END || CASE WHEN ev > 0 THEN '; value above stake' ELSE '' END AS text FROM s LEFT JOIN g USING (target)")
def signal_texts(spark, sf_dir):
    """A line a target on its rate, gap and value."""
    s = statistics.threshold_snapshot(spark, sf_dir).join(F.broadcast(probabilities.gap_pressure(spark, sf_dir)), "target", "left")
    rate = F.when(F.col("recent") > 1.15 * F.col("fair"), "above the fair rate").when(F.col("recent") < 0.85 * F.col("fair"), "below the fair rate").otherwise("near the fair rate")
    gap = F.when(F.col("hard") > 0, "gap beyond the ninth decile").when(F.col("soft") > 0, "gap beyond the third quartile")
    return s.select("target", F.concat_ws("; ", rate, gap, F.when(F.col("ev") > 0, "value above stake")).alias("text"))


@query(f"WITH {R}, c AS (SELECT source_key, CASE WHEN multiplier >= 10 THEN 'hot' WHEN multiplier >= 2 THEN 'warm' ELSE 'cold' END AS phase, count(*) AS n FROM rounds GROUP BY ALL) SELECT source_key, phase AS dominant, n, round(n / sum(n) OVER (PARTITION BY source_key), 9) AS share FROM c QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY n DESC, phase) = 1")
def dominant_label(spark, sf_dir):
    """The label that most rounds of a source have (of ties the first), and its share."""
    c = statistics.label_counts(spark, sf_dir)
    return c.groupBy("source_key").agg(F.min_by("phase", F.struct(-F.col("n"), "phase")).alias("dominant"), F.max("n").alias("n"), F.round(F.max("n") / F.sum("n"), 9).alias("share"))


@query(f"WITH e AS ({ORACLES['exceedance']}), q(q) AS (VALUES (0.9), (0.5), (0.2), (0.05), (0.001)) SELECT q::DOUBLE AS q, max(bucket) FILTER (WHERE exceedance >= q) AS bucket FROM e, q GROUP BY q")
def exceedance_quantile(spark, sf_dir):
    """The highest bucket that is reached with at least the chance q."""
    e = probabilities.exceedance(spark, sf_dir)
    return e.crossJoin(param(spark, "q double", (0.9, 0.5, 0.2, 0.05, 0.001))).groupBy("q").agg(F.max(F.when(F.col("exceedance") >= F.col("q"), F.col("bucket"))).alias("bucket"))


_STATE10 = f"{I}, s AS (SELECT idx, multiplier, idx - coalesce(max(CASE WHEN multiplier >= 10 THEN idx END) OVER (ORDER BY idx), -1) AS gap, min(CASE WHEN multiplier >= 10 THEN idx END) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM i), q AS (SELECT gap, idx AS now FROM s ORDER BY idx DESC LIMIT 1), w AS (SELECT exp(-0.9 * abs(ln(1 + s.gap) - ln(1 + q.gap))) AS w, nxt - idx AS wait FROM s, q WHERE idx >= 120 AND idx < now AND nxt IS NOT NULL)"


@query(f"WITH {_STATE10}, g AS (SELECT quantile_cont(d, 0.25) AS q25, quantile_cont(d, 0.5) AS q50 FROM (SELECT idx - lag(idx) OVER (ORDER BY idx) AS d FROM i WHERE multiplier >= 10) WHERE d IS NOT NULL), h AS (SELECT avg((multiplier >= 10)::INT) AS p FROM i) SELECT round((0.42 * coalesce(sum(w * (wait <= 1.5)::INT) / sum(w), 0) + 0.28 * coalesce(sum(w * (wait <= 2.5)::INT) / sum(w), 0) + 0.12 * coalesce(sum(w * (wait <= 3.5)::INT) / sum(w), 0) + 0.18 * (1 - (1 - max(p)) * (1 - max(p)))) * CASE WHEN max(q.gap) <= max(q25) THEN 1 WHEN max(q.gap) <= max(q50) THEN 0.72 ELSE 0.45 END, 6) AS quick FROM w, g, h, q")
def quick_hit(spark, sf_dir):
    """The chance of a hit of 10 within two rounds, from the waits after states of a
    like gap and from the plain rate, and fresh gaps counting more."""
    s = ordered.gap_counts(rounds(spark, sf_dir), F.col("multiplier") >= 10, since=120)
    weight = F.exp(-0.9 * F.abs(F.log1p("passed") - F.log1p("open")))
    within = lambda k: F.coalesce(F.sum(F.when(F.col("gap") - F.col("passed") <= k, F.col("n") * weight)) / F.sum(F.col("n") * weight), F.lit(0.0))
    inside, p = F.col("passed").isNotNull(), F.max(F.when(F.col("passed").isNotNull(), F.col("rate"))).alias("p")
    a = s.agg(within(1).alias("one"), within(2).alias("two"), within(3).alias("three"), p, F.max(F.when(inside, F.col("open"))).alias("gap0"), F.percentile("gap", F.array(F.lit(0.25), F.lit(0.5)), F.col("whole")).alias("q"))
    fresh = F.when(F.col("gap0") <= F.col("q")[0], 1.0).when(F.col("gap0") <= F.col("q")[1], 0.72).otherwise(0.45)
    return a.select(F.round((0.42 * F.col("one") + 0.28 * F.col("two") + 0.12 * F.col("three") + 0.18 * (1 - (1 - F.col("p")) * (1 - F.col("p")))) * fresh, 6).alias("quick"))


def cooldown(target: Column, span: Column, outcome: Column, strength: Column, early_by: Column, quality: Column) -> Column:
    """Rounds by which the next window moves after an outcome while low values press:
    later after a loss or a win, earlier by a part of what an early hit was early by,
    and then a little later again."""
    clip = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    near = lambda x: F.floor(x + 0.5)
    low = strength >= 0.45
    least, part = F.when(target <= 20, 3).when(target <= 100, 4).otherwise(6), F.when(target <= 10, 0.95).when(target <= 20, 0.80).when(target <= 100, 0.62).otherwise(0.45)
    lost = F.greatest(F.lit(2), near(F.greatest(least, near(span * part)) * clip(0.55 + 0.35 * strength, 0.55, 1.65)))
    won = F.greatest(F.lit(1), near(span * clip(0.16 + 0.08 * strength, 0.16, 0.40)))
    pull = near(F.least(F.greatest(F.lit(1), early_by), 2 * span) * (0.45 + 0.35 * quality))
    eased = F.greatest(F.lit(0), near(F.greatest(F.lit(1), pull) * clip(1 - 0.35 * strength, 0.15, 0.75)))
    early = F.when(low, F.greatest(F.lit(1), near(span * 0.22)) - eased).otherwise(-F.greatest(F.lit(1), pull))
    return F.when(outcome == "early", early).when(low & (outcome == "loss"), lost).when(low & (outcome == "win"), won).otherwise(0).cast("long")


_PRESS = f"{R}, {LEDGER}, l24 AS (SELECT round_id, avg((multiplier < 2)::INT) OVER (ORDER BY round_id ROWS 23 PRECEDING) AS low FROM rounds), x AS (SELECT ledger.*, greatest(0, least(3, 1.8 * (low - 0.25))) AS strength, greatest(1, lo - hit) AS early_by, low >= 0.7 AS idle FROM ledger JOIN l24 ON l24.round_id = made)"
_CLIP = lambda x, low, high: f"greatest({low}, least({high}, {x}))"
_NEAR = lambda x: f"floor({x} + 0.5)"
_LOST = f"greatest(2, {_NEAR('greatest(CASE WHEN target <= 20 THEN 3 WHEN target <= 100 THEN 4 ELSE 6 END, floor(span * CASE WHEN target <= 10 THEN 0.95::DOUBLE WHEN target <= 20 THEN 0.80 WHEN target <= 100 THEN 0.62 ELSE 0.45 END + 0.5)) * ' + _CLIP('0.55 + 0.35 * strength', 0.55, 1.65))})"
_PULL = _NEAR("least(early_by, 2 * span) * (0.45 + 0.35 * 0.5)::DOUBLE")
_MOVE = f"CASE WHEN outcome = 'early' THEN CASE WHEN strength >= 0.45 THEN greatest(1, {_NEAR('span * 0.22::DOUBLE')}) - greatest(0, {_NEAR(f'greatest(1, {_PULL}) * ' + _CLIP('1 - 0.35 * strength', 0.15, 0.75))}) ELSE -greatest(1, {_PULL}) END WHEN strength >= 0.45 AND outcome = 'loss' THEN {_LOST} WHEN strength >= 0.45 AND outcome = 'win' THEN greatest(1, {_NEAR('span * ' + _CLIP('0.16 + 0.08 * strength', 0.16, 0.40))}) ELSE 0 END"


def pressed(spark, sf_dir) -> DataFrame:
    """The ledger with low, the share of low values in the 24 rows up to each lock."""
    s = ordered.framed(sequence(spark, sf_dir), 23, 0, lambda rows: {"low": F.avg((F.col("multiplier") < 2).cast("int")).over(rows(-23, 0))})
    return ledger(spark, sf_dir).join(s.where("round_id % 100 = 0").select(F.col("round_id").alias("made"), "low"), "made")


@query(f"WITH {_PRESS} SELECT target, made, outcome, CAST({_MOVE} AS BIGINT) AS move FROM x")
def lock_cooldowns(spark, sf_dir):
    """How far the lock after each outcome moves, by the pressure of low values."""
    strength = F.greatest(F.lit(0.0), F.least(F.lit(3.0), 1.8 * (F.col("low") - 0.25)))
    early_by = F.greatest(F.lit(1).cast("long"), F.col("lo") - F.col("hit"))
    return pressed(spark, sf_dir).select("target", "made", "outcome", cooldown(F.col("target"), F.col("span"), F.col("outcome"), strength, early_by, F.lit(0.5)).alias("move"))


@query(f"WITH {_PRESS}, n AS (SELECT max(round_id) AS now FROM rounds) SELECT target, made, CASE WHEN idle THEN 'idle' WHEN outcome <> 'loss' OR hi <= now THEN 'resolved' WHEN lo <= now THEN 'window-open' ELSE 'locked' END AS state, idle AS suspended FROM x, n")
def lock_states(spark, sf_dir):
    """Locks made under too many low values are idle and stay as they are; others are
    resolved, open or waiting."""
    now = F.broadcast(rounds(spark, sf_dir).agg(F.max("round_id").alias("now")))
    idle = F.col("low") >= 0.7
    state = F.when(idle, "idle").when((F.col("outcome") != "loss") | (F.col("hi") <= F.col("now")), "resolved").when(F.col("lo") <= F.col("now"), "window-open").otherwise("locked")
    return pressed(spark, sf_dir).crossJoin(now).select("target", "made", state.alias("state"), idle.alias("suspended"))
