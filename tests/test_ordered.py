"""Blocks of any size give what one ordered window gives."""

import random

import pytest
from pyspark.sql import functions as F

from roundwise import catalog
from roundwise.operators import joins, ordered


def sequence(n, seed):
    pick, at, out = random.Random(seed), 0, []
    for _ in range(n):
        at += pick.choice([1, 1, 2, 9])
        out.append((at, float(pick.randrange(12))))
    return out


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_blocks(spark, block):
    data = sequence(90, 1)
    df = ordered.indexed(spark.createDataFrame(data, "round_id long, multiplier double").repartition(3), block=block)
    hit = F.col("multiplier") >= 8
    df = ordered.carried(df, "last", F.when(hit, F.col("idx")), block=block)
    df = ordered.carried(df, "next", F.when(hit, F.col("idx")), forward=False, inclusive=False, block=block)
    df = ordered.running_sum(df, "total", F.col("multiplier"), block=block)
    df = ordered.runs(df, "run", F.col("multiplier") < 5, block=block)
    df = ordered.framed(df, 3, 2, lambda rows: {"back": F.sum("multiplier").over(rows(-3, 0)), "ahead": F.max("multiplier").over(rows(1, 2))}, block=block)
    got = sorted(df.collect(), key=lambda r: r.idx)
    assert [r.round_id for r in got] == [i for i, _ in data]
    m = [x for _, x in data]
    for i, r in enumerate(got):
        hits = [j for j, x in enumerate(m) if x >= 8]
        run = 0
        while run <= i and m[i - run] < 5:
            run += 1
        assert r.idx == i and r.last == max((j for j in hits if j <= i), default=None) and r.next == min((j for j in hits if j > i), default=None)
        assert r.total == sum(m[: i + 1]) and r.run == run
        assert r.back == sum(m[max(0, i - 3) : i + 1]) and r.ahead == max(m[i + 1 : i + 3], default=None)


def test_empty_sequence(spark):
    df = ordered.indexed(spark.createDataFrame([], "round_id long, multiplier double"))
    df = ordered.runs(df, "run", F.col("multiplier") < 5)
    assert df.count() == 0


@pytest.mark.parametrize("stripe", [3, 4096])
def test_range_join(spark, stripe, monkeypatch):
    monkeypatch.setattr(joins, "STRIPE", stripe)
    data = sequence(80, 2)
    locks = [(t, a, a + w) for t in (3, 9, 50) for a in range(0, 120, 7) for w in (-1, 0, 4, 40)]
    got = joins.first_hit(spark.createDataFrame(locks, "target int, made long, hi long"), spark.createDataFrame(data, "round_id long, multiplier double"), F.col("hi")).collect()
    assert len(got) == len(locks)
    for r in got:
        assert r.hit == min((i for i, m in data if m >= r.target and r.made < i <= r.hi), default=None)


def test_plans_stay_parallel(spark):
    """No window of a sequence without a partition, no Cartesian product."""
    from roundwise import catalog

    for name in ("running_gap", "rolling_rates", "run_lengths", "state_vectors", "lock_resolution", "hazard_curve"):
        text = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text, name
    text = catalog.QUERIES["rounds_since"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,900)" in text


def test_values_ahead_take_one_step_a_row(spark):
    """A frame up to unbounded following is read anew for each row of a block."""
    df = spark.createDataFrame([(i, float(i % 9)) for i in range(300)], "idx long, multiplier double")
    ahead = ordered.carried_all(df, {"a": F.when(F.col("multiplier") == 8, F.col("idx")), "b": F.when(F.col("idx") % 50 == 0, F.col("idx"))}, forward=False, inclusive=False, block=64)
    locks = spark.createDataFrame([(8, i) for i in range(-1, 300, 7)], "target int, made long")
    hits = joins.next_hit(locks, df.withColumnRenamed("idx", "round_id"), block=64)
    for plan in (ahead, hits):
        assert "unboundedfollowing" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
    at = lambda i, step, off: next((j for j in range(i + 1, 300) if j % step == off), None)
    assert sorted((r.idx, r.a, r.b) for r in ahead.collect()) == [(i, at(i, 9, 8), at(i, 50, 0)) for i in range(300)]
    assert sorted((r.made, r.hit) for r in hits.collect()) == [(i, at(i, 9, 8)) for i in range(-1, 300, 7)]


@pytest.mark.parametrize("name", ["state_neighbours", "quick_hit", "next_hit"])
def test_queries_ahead_read_no_row_twice(spark, name):
    text = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in text


def _some_rounds(spark, n=700):
    """round_id with holes, longer than a block once, and values of which some are null."""
    ids = [3 * i + (400 if i > 300 else 0) for i in range(n)]
    values = [None if i % 41 == 7 else float((i * i * 31 + i) % 97) / (1 + i % 4) for i in range(n)]
    return values, spark.createDataFrame(list(zip(ids, values, strict=True)), "round_id long, multiplier double").repartition(3)


@pytest.mark.parametrize("level, since", [(10, 120), (60, 120), (10, 0), (2000, 120)])
def test_gap_counts_are_those_of_rows(spark, level, since):
    values, df = _some_rounds(spark)
    hits = [i for i, v in enumerate(values) if v is not None and v >= level]
    want, whole = {}, {}
    for a, b in zip([-1, *hits], hits, strict=False):
        if a >= 0:
            whole[b - a] = whole.get(b - a, 0) + 1
        for i in range(max(a, 0, since), b):
            want[b - a, i - a] = want.get((b - a, i - a), 0) + 1
    got = ordered.gap_counts(df, F.col("multiplier") >= level, since=since, block=64).collect()
    found, twice = {}, {}
    for r in got:
        twice[r.gap] = twice.get(r.gap, 0) + r.whole
        if r.passed is not None:
            found[r.gap, r.passed] = found.get((r.gap, r.passed), 0) + r.n
    assert found == want
    assert {g: n for g, n in twice.items() if n} == whole
    for r in got:
        assert r.open == len(values) - 1 - hits[-1] and r.rate == len(hits) / sum(v is not None for v in values)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_states_are_those_of_rows(spark, block):
    values, df = _some_rounds(spark)
    cuts = (5, 20, 60)
    level = sum(F.when(F.col("multiplier") >= t, 1).otherwise(0) for t in cuts)
    got = sorted(ordered.states(df, level, 3, F.col("multiplier") < 9, 2, block=block).collect(), key=lambda r: r.idx)
    assert [r.idx for r in got] == list(range(len(values)))
    reach = lambda t: [i for i, v in enumerate(values) if v is not None and v >= t]
    for r in got:
        i = r.idx
        some = [v < 9 for v in values[max(0, i - 23) : i + 1] if v is not None]
        assert [r.at1, r.at2, r.at3] == [max((j for j in reach(t) if j <= i), default=None) for t in cuts]
        assert r.nxt == min((j for j in reach(20) if j > i), default=None)
        assert r.u == (sum(some) / len(some) if some else None)
        assert r.q == (got[-1].idx, got[-1].at1, got[-1].at2, got[-1].at3, got[-1].u)


@pytest.mark.parametrize("name, most", [("state_neighbours", 2), ("quick_hit", 1)])
def test_queries_ahead_read_their_table_few_times(spark, name, most):
    text = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") <= most
