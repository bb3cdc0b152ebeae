"""K-means, quantiles and following hits against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roundwise.operators import clustering, joins, ordered, quantiles
from roundwise.plans import forecasts

NAMES = ["x", "y", "z"]


def plain_fit(x, k, rounds):
    centres = [x[min(len(x) - 1, int(len(x) * 0.31))]]
    while len(centres) < k:
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[int(np.argmax(far))])
    centres = np.array(centres)
    for _ in range(rounds):
        at = np.argmin([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        new = np.array([x[at == i].mean(axis=0).round(9) if (at == i).any() else centres[i] for i in range(k)])
        if (new == centres).all():
            break
        centres = new
    return centres


def plain_bic(x, centres):
    far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
    return len(x) * np.log(max(1e-9, far.sum() / len(x))) + centres.size * np.log(len(x))


def test_kmeans_equals_plain(spark):
    pick = np.random.default_rng(4)
    x = np.concatenate([pick.normal(m, 0.4, (70, 3)) for m in (0, 3, 7, 12)])[pick.permutation(280)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "idx long, x double, y double, z double").repartition(3)
    seeds = clustering.seeds(df, NAMES, 6)
    models = clustering.fit(df, NAMES, {k: seeds[:k] for k in (2, 4, 6)}, 5)
    for k, centres in models.items():
        assert np.allclose(centres, plain_fit(x, k, 5))
    scores = clustering.bic(df, NAMES, models)
    assert all(scores[k] == pytest.approx(plain_bic(x, models[k])) for k in models)
    best = clustering.chosen(df, NAMES, range(2, 7), 5, 9)
    want = min(range(2, 7), key=lambda k: plain_bic(x, plain_fit(x, k, 5)))
    assert len(best) == want and np.allclose(best, plain_fit(x, want, 9))
    got = {r.idx: r.cluster for r in clustering.assigned(df, NAMES, best).collect()}
    assert [got[i] for i in range(280)] == np.argmin([((x - c) ** 2).sum(axis=1) for c in best], axis=0).tolist()
    assert len(clustering.chosen(df.limit(0), NAMES, range(2, 4))) == 0
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(5)], "idx long, x double, y double, z double")
    assert clustering.chosen(same, NAMES, range(2, 4)).tolist() == [[1.0, 1.0, 1.0]]


def test_kmeans_query_equals_plain(spark):
    """The query's clusters, from its own features."""
    sf = "/root/testdata/sf0.001"
    rows = sorted(forecasts.scaled16(spark, sf).collect(), key=lambda r: r.idx)
    x = np.array([[r[n] for n in forecasts.NAMES16] for r in rows])
    k = min(range(4, 13), key=lambda k: (plain_bic(x, plain_fit(x, k, 8)), k))
    at = np.argmin([((x - c) ** 2).sum(axis=1) for c in plain_fit(x, k, 12)], axis=0)
    want = {}
    for c, r in zip(at.tolist(), rows, strict=True):
        if r.next is not None:
            want.setdefault(c, []).append(r)
    got = {r.cluster: r for r in forecasts.kmeans_regimes(spark, sf).collect()}
    assert {c: r.n for c, r in got.items()} == {c: len(v) for c, v in want.items()}
    for c, v in want.items():
        assert got[c].mean_next == pytest.approx(np.mean([r.next for r in v]), abs=1e-5) and got[c].p_hit5 == pytest.approx(np.mean([r.next >= 5 for r in v]), abs=1e-5)


@pytest.mark.parametrize("blocks", [2, 5, 256])
def test_quantiles_equal_plain(spark, blocks, monkeypatch):
    monkeypatch.setattr(quantiles.cumulative, "__defaults__", (None, blocks))
    pick = random.Random(1)
    rows = [(s, float(pick.randrange(m)), pick.randrange(1, 5)) for s, n, m in (("a", 301, 40), ("b", 50, 9999), ("c", 1, 5)) for _ in range(n)] + [("c", None, 3)]
    df = spark.createDataFrame(rows, "s string, v double, w long")
    shares = {"q0": 0.0, "q25": 0.25, "q82": 0.82, "q100": 1.0}
    for r in quantiles.interpolated(df, ("s",), "v", shares).collect():
        x = [v for s, v, _ in rows if s == r.s and v is not None]
        assert [r[n] for n in shares] == pytest.approx(np.quantile(x, list(shares.values())).tolist())
    for r in quantiles.first_reaching(df, ("s",), "v", F.col("w"), {"q50": 0.5}).collect():
        x = sorted((v, w) for s, v, w in rows if s == r.s and v is not None)
        total, upto = sum(w for _, w in x), np.cumsum([w for _, w in x])
        assert r.q50 == x[int(np.argmax(upto / total >= 0.5))][0]


def test_following_hits_and_running_maxima_by_blocks(spark):
    pick = random.Random(3)
    hits = [(i, float(pick.randrange(12))) for i in range(0, 400, 3)]
    locks = [(t, a) for t in (3, 10, 50) for a in range(-5, 420, 11)]
    got = joins.next_hit(spark.createDataFrame(locks, "target int, made long"), spark.createDataFrame(hits, "round_id long, multiplier double"), block=40).collect()
    assert len(got) == len(locks) and all(r.hit == min((i for i, m in hits if m >= r.target and i > r.made), default=None) for r in got)
    seq = spark.createDataFrame([(k, i, pick.choice([None, pick.randrange(99)])) for k in "ab" for i in range(50)], "k string, idx long, v long")
    for inclusive in (True, False):
        for r in ordered.running_max(seq, "top", F.col("v"), ("k",), inclusive, 7).collect():
            want = [x.v for x in seq.where(f"k = '{r.k}'").collect() if x.idx < r.idx + inclusive and x.v is not None] if r.idx % 13 == 0 else None
            assert want is None or r.top == max(want, default=None)
