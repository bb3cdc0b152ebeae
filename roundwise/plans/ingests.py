"""Ingest: feeds to rounds, and deliveries merged into what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundwise.catalog import query
from roundwise.plans.fixtures import R, param, rounds
from roundwise.plans.scans import BATCHES, SITES, batches, sites
from roundwise.sources import feeds, merges

NOW = 1_700_000_000_000
#: Of the time column, which has no zone.
MILLIS_SQL = ("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


@query(f"WITH {R} SELECT round_id, multiplier, (epoch_us(ts) // 1000) AS timestamp FROM rounds WHERE round_id % 11 <> 0")
def normalize_feed(spark, sf_dir):
    """A feed whose rows take five shapes (and some are broken) becomes rounds."""
    r = rounds(spark, sf_dir)
    i, m, t = F.col("round_id"), F.col("multiplier"), F.expr(MILLIS_SQL)
    shapes = [
        F.to_json(F.struct(i.alias("roundId"), m.alias("multiplier"), t.alias("timestamp"))),
        F.to_json(F.struct(i.cast("string").alias("round_id"), F.concat(m.cast("decimal(38,4)").cast("string"), F.lit("x")).alias("bust"), t.alias("timestamp"))),
        F.to_json(F.struct(i.alias("id"), m.alias("crashPoint"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("createdAt"))),
        F.to_json(F.struct(i.alias("gameId"), m.alias("payout"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("Z")).alias("time"))),
        F.concat(F.lit("["), i, F.lit(',"'), m.cast("decimal(38,4)").cast("string"), F.lit('",'), t, F.lit("]")),
    ]
    shape = F.element_at(F.array(*shapes), (i % 5 + 1).cast("int"))
    row = F.when(i % 11 == 0, F.lit('{"roundId": 5, "multiplier": "n/a"}')).otherwise(shape)
    box = F.element_at(F.array(F.concat(F.lit("["), row, F.lit("]")), F.concat(F.lit('{"data":{"rounds":['), row, F.lit("]}}")), F.concat(F.lit('{"payload":['), row, F.lit("]}"))), (i % 3 + 1).cast("int"))
    each = r.select(F.explode(feeds.rows_of(box)).alias("row"))
    return feeds.normalized(each, "row", NOW).select("round_id", "multiplier", "timestamp")


SCORE = " + ".join([f"CASE WHEN regexp_matches(lower(url), '{p}') THEN {n} ELSE 0 END" for p, n in feeds.SCORES])


@query(f"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1)) AS url, 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) AS origin FROM pages), a AS (SELECT page_id, origin, CASE WHEN url LIKE '/%' THEN origin || url ELSE url END AS url FROM u), d AS (SELECT DISTINCT page_id, url, CASE WHEN contains(lower(url), origin) THEN 6 ELSE 0 END + CASE WHEN regexp_matches(lower(url), '{feeds.NO_FEED}') THEN 0 ELSE -3 END + {SCORE} AS score FROM a) SELECT page_id, url, CAST(score AS INT) AS score FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) <= 3""")
def url_candidates(spark, sf_dir):
    """Addresses in pages, resolved, distinct, scored: the best three a page."""
    from pyspark.sql import Window

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    origin = F.concat(F.lit("https://"), F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    found = pages.select("page_id", origin.alias("origin"), F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), F.lit(1))).alias("url"))
    url = F.when(F.col("url").startswith("/"), F.concat("origin", "url")).otherwise(F.col("url"))
    scored = found.select("page_id", "origin", url.alias("url")).distinct().select("page_id", "url", feeds.address_score(F.col("url"), F.col("origin")).alias("score"))
    best = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "url"))
    return scored.withColumn("place", best).where("place <= 3").select("page_id", "url", "score")


@query("SELECT page_id, lower(regexp_replace(regexp_replace(trim(url), '/+$', ''), '[?#].*$', '')) AS game_key, regexp_replace(regexp_replace(lower(trim(regexp_extract(url, '^https?://([^/?#]+)', 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_matches(html, '(?i)just a moment|enable javascript and cookies|cf-challenge|challenge-platform') AS challenge FROM pages")
def slug_keys(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return pages.select("page_id", feeds.game_key(F.col("url")).alias("game_key"), feeds.slug(host).alias("slug"), feeds.is_challenge(F.col("html")).alias("challenge"))


@query("WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www[.]', '') AS host FROM pages) SELECT page_id, array_to_string(list_transform(regexp_extract_all(host, '[a-z0-9_]+|[^a-z0-9_]+'), lambda w: upper(w[1]) || substr(w, 2)), '') AS label FROM h")
def site_labels(spark, sf_dir):
    """A name for the host of each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", feeds.host_label(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("label"))


@query(f"WITH {R}, h AS (SELECT round_id, multiplier, (epoch_us(ts) // 1000) AS ms, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(source_key, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS hash FROM rounds) SELECT round_id, CAST(substr(ms::VARCHAR || lpad(CAST(floor(multiplier * 1000 + 0.5) AS BIGINT)::VARCHAR, greatest(4, length(CAST(floor(multiplier * 1000 + 0.5) AS BIGINT)::VARCHAR))::INT, '0') || lpad(abs(hash % 1000)::VARCHAR, 3, '0'), 1, 15) AS BIGINT) AS synthetic_id, hash FROM h")
def synthetic_ids(spark, sf_dir):
    r = rounds(spark, sf_dir)
    return r.select("round_id", feeds.synthetic_id(F.col("source_key"), F.col("multiplier"), F.expr(MILLIS_SQL)).alias("synthetic_id"), feeds.java_hash(F.col("source_key")).alias("hash"))


@query("WITH k AS (SELECT event_id, CAST(floor(event_id / 10) AS BIGINT) AS round_id, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS k FROM events) SELECT round_id, coalesce(string_agg(CASE k WHEN 0 THEN 'C' WHEN 1 THEN 'B' WHEN 2 THEN 'A' END, '' ORDER BY event_id), '') AS ingested, coalesce(string_agg(CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END, '' ORDER BY event_id), '') AS read FROM k GROUP BY round_id")
def tower_parse(spark, sf_dir):
    """Sequences in JSON to letters, by the code map of ingest and that of reads."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long") % 4
    code = F.element_at(F.array(*map(F.lit, ("3", "5", "6", "9"))), (k + 1).cast("int"))
    entry = F.struct(F.col("event_id").alias("level"), code.alias("result"))
    t = e.groupBy(F.floor(F.col("event_id") / 10).alias("round_id")).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("raw"))
    return t.select("round_id", feeds.tower_letters(F.col("raw"), feeds.INGEST_LETTERS).alias("ingested"), feeds.tower_letters(F.col("raw"), feeds.READ_LETTERS).alias("read"))


@query(f"WITH {BATCHES} SELECT round_id, arg_min(multiplier, arrival) AS multiplier FROM batches GROUP BY round_id")
def insert_ignore(spark, sf_dir):
    b = batches(spark, sf_dir)
    return merges.insert_ignore(b.where("arrival = 1").drop("arrival"), b.where("arrival = 2"), ["round_id"], "arrival").select("round_id", "multiplier")


@query(f"WITH {BATCHES} SELECT round_id, arg_max(multiplier, arrival) AS multiplier FROM batches GROUP BY round_id")
def upsert_last_wins(spark, sf_dir):
    b = batches(spark, sf_dir)
    return merges.upsert(b.where("arrival = 1").drop("arrival"), b.where("arrival = 2"), ["round_id"], "arrival")


@query(f"WITH {R} SELECT round_id, multiplier FROM rounds WHERE round_id > (SELECT max(round_id) FROM rounds WHERE round_id <= 800)")
def watermark_filter(spark, sf_dir):
    """Only ids above the highest stored one."""
    r = rounds(spark, sf_dir).select("round_id", "multiplier")
    mark = r.where("round_id <= 800").agg(F.max("round_id").alias("mark"))
    return r.crossJoin(F.broadcast(mark)).where("round_id > mark").select("round_id", "multiplier")


@query(f"WITH {R} SELECT round_id, multiplier FROM rounds WHERE round_id BETWEEN 200 AND 420 AND round_id % 3 = 0")
def gap_backfill(spark, sf_dir):
    """A page of the feed fills what an outage left out of the store."""
    r = rounds(spark, sf_dir).select("round_id", "multiplier")
    stored = r.where("NOT (round_id BETWEEN 200 AND 420 AND round_id % 3 = 0)")
    return r.where("round_id BETWEEN 100 AND 500").join(stored, "round_id", "left_anti")


@query(f"WITH {SITES}, seed(source_key, game_url) AS (VALUES ('view', 'https://view.example.com/new'), ('fresh', 'https://fresh.example.com/crash'), ('click', NULL)) SELECT coalesce(s.source_key, d.source_key) AS source_key, coalesce(d.game_url, s.game_url) AS game_url, coalesce(s.enabled, true) AS enabled FROM (SELECT * FROM sites WHERE source_key <> 'error') s FULL JOIN seed d ON d.source_key = s.source_key")
def registry_seed(spark, sf_dir):
    """Defaults are added or repaired, deprecated sources deleted."""
    seed = param(spark, "source_key string, fixed string", [("view", "https://view.example.com/new"), ("fresh", "https://fresh.example.com/crash"), ("click", None)])
    s = sites(spark, sf_dir).where("source_key <> 'error'")
    return s.join(seed, "source_key", "full").select("source_key", F.coalesce("fixed", "game_url").alias("game_url"), F.coalesce("enabled", F.lit(True)).alias("enabled"))


@query(f"WITH {SITES} SELECT source_key, enabled, CASE WHEN source_key = 'click' THEN 'down' WHEN source_key = 'error' THEN NULL ELSE last_error END AS last_error FROM sites")
def site_patch(spark, sf_dir):
    """A partial change: null is a value, absence is none."""
    changes = param(spark, "source_key string, last_error string, has_last_error boolean", [("click", "down", True), ("error", None, True), ("view", "ignored", False)])
    return merges.patch(sites(spark, sf_dir), changes, ["source_key"]).select("source_key", "enabled", "last_error")


@query("WITH k AS (SELECT event_id, CAST(floor(event_id / 10) AS BIGINT) AS round_id, substr('ABC', CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 3 + 1 AS INT), 1) AS l FROM events), s AS (SELECT round_id, string_agg(l, '' ORDER BY event_id) AS actual FROM k GROUP BY round_id) SELECT round_id, substr(actual, 2) || 'A' AS forecast, actual, CASE WHEN substr(actual, 2) || 'A' = actual OR round_id % 2 = 0 THEN 'WIN' ELSE 'LOSS' END AS outcome FROM s WHERE length(actual) = 10")
def tower_upsert(spark, sf_dir):
    """History of sequence forecasts: the last delivery of a round stays, outcomes
    are forced to WIN or LOSS, incomplete rows are dropped."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    letter = F.substring(F.lit("ABC"), (F.get_json_object("props", "$.k").cast("long") % 3 + 1).cast("int"), F.lit(1))
    s = e.groupBy(F.floor(F.col("event_id") / 10).alias("round_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", letter.alias("l")))), lambda x: x["l"]), "").alias("actual"))
    s = s.where(F.length("actual") == 10).withColumn("forecast", F.concat(F.expr("substr(actual, 2)"), F.lit("A")))
    said = lambda ok: F.when((F.col("forecast") == F.col("actual")) | ok, "WIN").otherwise("LOSS")
    first = s.select("round_id", "forecast", "actual", F.lit("LOSS").alias("outcome"))
    again = s.select("round_id", "forecast", "actual", said(F.col("round_id") % 2 == 0).alias("outcome"), F.lit(1).alias("arrival"))
    return merges.upsert(first, again, ["round_id"], "arrival")
