"""Feeds read values as they are written, whatever their size."""

import duckdb

from roundwise import catalog
from roundwise.sources import feeds


def test_numbers_with_exponents(spark):
    said = {"1.26424117E7": 12642411.7, "1.0E-4": 0.0001, "-2e3": -2000.0, "12.5x": 12.5, "1,234.5": 1234.5, "3 e": 3.0, "n/a": None}
    got = spark.createDataFrame([(s,) for s in said], "s string").select("s", feeds.number(feeds.F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == said


def test_large_rounds_equal_sql(spark, tmp_path):
    """Multipliers of ten million and more are written with an exponent."""
    path = f"{tmp_path}/events.parquet"
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i % 7 AS user_id, 'view' AS event_type, [3.5, 817.61, 560.21][i % 3 + 1] + i / 8.0 AS value, '{{\"k\": 1}}' AS props FROM range(250) t(i)) TO '{path}'")
    for name in ("fetch_pages", "normalize_feed"):
        duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{path}'")
        want = sorted(duckdb.sql(catalog.ORACLES[name]).fetchall())
        got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("round_id", "multiplier", "timestamp").collect())
        assert len(got) == len(want) and max(r[1] for r in want) > 1e7
        assert all(g[0] == w[0] and abs(g[1] - w[1]) <= 1e-9 * w[1] and g[2] == w[2] for g, w in zip(got, want, strict=True))
