"""Schemas of the stored tables, and old layouts brought to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns and types of each table, and the keys that are unique.
SCHEMAS = {
    "rounds": "round_id long, multiplier decimal(12,4), timestamp long, created_at timestamp",
    "predictions": "target string, min_mult decimal(12,4), outcome string, window_lo long, window_hi long, hit_round long, generation int, source string, prob_w decimal(8,6), issue_mode string, regime_mode string, created_at timestamp",
    "oracle_active_locks": "target string, source string, min_mult decimal(12,4), predicted_round long, window_lo long, window_hi long, window_size int, snap_at long, last_hit_id long, generation int, confidence decimal(8,4), issue_mode string, regime_mode string, updated_at timestamp",
    "crash_sites": "id long, source_key string, label string, game_url string, adapter string, api_url string, enabled boolean, poll_interval_ms int, last_polled_at timestamp, last_success_at timestamp, last_error string, last_round_id long",
    "crash_rounds": "id long, site_id long, source_key string, round_id long, multiplier decimal(12,4), timestamp long, raw_payload string, created_at timestamp",
    "tower_prediction_history": "site_id long, source_key string, round_id long, forecast string, actual string, matches short, accuracy short, outcome string, created_at timestamp",
}
KEYS = {"rounds": ("round_id",), "predictions": ("source", "target", "window_lo", "window_hi", "generation"), "oracle_active_locks": ("target",), "crash_sites": ("source_key",), "crash_rounds": ("site_id", "round_id"), "tower_prediction_history": ("site_id", "round_id")}


def columns_of(table: str) -> list[tuple[str, str]]:
    parts, depth = [""], 0
    for c in SCHEMAS[table]:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [tuple(p.split(maxsplit=1)) for p in parts]


def conform(df: DataFrame, table: str, **fill) -> DataFrame:
    """df in the table's layout: columns it lacks are null, or what fill says, other
    types are cast where that is possible, and columns of no table go."""
    have = set(df.columns)
    value = lambda name: F.col(name) if name in have else F.lit(fill.get(name))
    filled = lambda name: F.coalesce(value(name), F.lit(fill[name])) if name in fill else value(name)
    return df.select(*[filled(n).try_cast(t).alias(n) for n, t in columns_of(table)])
