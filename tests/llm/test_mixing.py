import itertools
import random

import pytest

from roundwise.llm import mixing


def test_targets_reshare_what_is_above():
    sizes = {"b": 10, "a": 1, None: 50, "c": 39, "d": 0}
    got = mixing.targets(sizes)
    assert sum(got.values()) == pytest.approx(100) and all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    # a: 5/14 of 100 over 3, d: 5/14 over 0; b 2, c 1, null 2 share 97: 38.8 over 30; c, null share 67
    assert got == pytest.approx({"a": 3, "d": 0, "b": 30, "c": 67 / 3, None: 134 / 3})
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_route_equals_brute_force():
    """Two sources, a pattern of each and one of both, all ways to route whole tokens."""
    pick = random.Random(9)
    for _ in range(20):
        texts = {0: pick.randrange(1, 4), 1: pick.randrange(1, 4), 2: pick.randrange(1, 3)}
        rows = {(0, "a"): texts[0], (1, "b"): texts[1], (2, "a"): texts[2] + pick.randrange(2), (2, "b"): texts[2]}
        quota = {"a": float(pick.randrange(9)), "b": float(pick.randrange(9))}
        got = mixing.route(texts, rows, quota)
        best = None
        cost = lambda g, t: sum(min(max(g - r * t, 0), t) * r * (r + 1) / 2 for r in range(12))
        for a, b, ca, cb in itertools.product(*[range(3 * rows[k] + 1) for k in ((0, "a"), (1, "b"), (2, "a"), (2, "b"))]):
            if a + ca <= quota["a"] and b + cb <= quota["b"]:
                c = (-(a + b + ca + cb), cost(a, texts[0]) + cost(b, texts[1]) + cost(ca + cb, texts[2]))
                best = c if best is None or c < best else best
        assert all(got[k] <= 3 * rows[k] + 1e-6 for k in rows)
        both = got[2, "a"] + got[2, "b"]
        assert (-sum(got.values()), cost(got[0, "a"], texts[0]) + cost(got[1, "b"], texts[1]) + cost(both, texts[2])) == pytest.approx(best)


def op2(spark, path, rows, parts=5):
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return mixing.op2_mixing(spark, str(path)).toPandas()


def test_equal_rows_are_taken_in_part(spark, tmp_path):
    text = " ".join(["w"] * 100)
    got = op2(spark, tmp_path, [(1, text, "a")] * 1000 + [(i, text + f" {i}", "b") for i in range(1000)])
    per = got.groupby("target").taken.sum()
    assert len(per) == 2 and all(abs(taken - target) <= 101 for target, taken in per.items()), per
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.mix(spark, docs).count() == (got.taken // got["size"]).sum()


def test_texts_of_several_sources_are_routed(spark, tmp_path, monkeypatch):
    """A source with more than enough leaves the texts it shares to the one that
    must repeat; and with no room for patterns, each source goes by itself."""
    shared = [" ".join(f"s{i}{j}" for j in range(50)) for i in range(200)]
    rows = [(i, t, "a") for i, t in enumerate(shared)] + [(1000 + i, t, "b") for i, t in enumerate(shared)]
    rows += [(2000 + i, " ".join(f"b{i}{j}" for j in range(50)), "b") for i in range(600)] + [(9, "x " * 30000, "c"), (10, None, None), (10, " ", None)]
    for limit in (400, 0):
        monkeypatch.setattr(mixing, "MAX_PATTERNS", limit)
        got = op2(spark, tmp_path, rows).set_index("doc_id", append=True).reset_index(level=1)
        per = got.groupby(["source_size", "target"]).taken.sum()
        assert all(abs(taken - target) <= 30000 * (size == 30000) + 50 for (size, target), taken in per.items()), per
        assert (got.taken <= 3 * got["size"]).all()
        of_b = got[(got.doc_id >= 1000) & (got.doc_id < 1200)].taken.sum()
        assert of_b == 0 if limit else of_b > 0


def test_mix_comes_near_targets(spark):
    pick = random.Random(1)
    rows = [(i, " ".join(["w"] * pick.randrange(60)), pick.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)]
    rows += [(7, None, "e"), (7, "", "e"), (8, "x y", "f"), (8, "x y", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    (docs.write.mode("overwrite").parquet(path := "/tmp/roundwise-test-mix/documents.parquet"))
    got = mixing.op2_mixing(spark, path.rsplit("/", 1)[0]).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    per = got.groupby(["source_size", "target"]).taken.sum()
    assert len(per) == 6 and all(abs(taken - target) <= 10 for (_, target), taken in per.items()), per
    again = mixing.op2_mixing(spark, path.rsplit("/", 1)[0]).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    mixed = mixing.mix(spark, docs)
    assert mixed.columns == docs.columns and mixed.count() == (got.taken / got["size"].clip(lower=1)).sum() + mixed.where("size(split(trim(text), ' +')) = 1 and trim(text) = ''").count()
    assert mixing.mix(spark, docs.limit(0)).count() == 0


def test_many_sources_without_broadcasts(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(["w"] * (10 + i % 7)), f"s{i % 90}") for i in range(900)]
    few = op2(spark, tmp_path, rows).sort_values("doc_id").values.tolist()
    monkeypatch.setattr(mixing, "FEW", 0)
    assert op2(spark, tmp_path, rows).sort_values("doc_id").values.tolist() == few


def test_no_pattern_is_left_out(spark):
    """Texts of a dozen sources, and more patterns than were once kept."""
    names = [f"s{i:02}" for i in range(60)]
    pairs = list(itertools.combinations(names, 2))[:500]
    rows = [(s, 10, i) for i, pair in enumerate(pairs) for s in pair] + [(s, 7, 9999) for s in names[:12]] + [(s, 5, 7777) for s in names]
    several, most = mixing.overlaps(spark.createDataFrame(rows, "source string, size long, t long"))
    found = {r.t: r.pattern for r in several.collect()}
    assert set(found) == {t for _, _, t in rows} and len(set(found.values())) == len(most) == 502
    assert dict(most)[found[9999]] == 7 and dict(most)[found[7777]] == 5 and len(found[7777]) == 64


def test_many_patterns_are_routed():
    """What is fresh goes first: no pattern is taken twice while quotas can do with one."""
    pick = random.Random(5)
    names = [f"s{i}" for i in range(30)]
    texts, rows = {}, {}
    for p in range(4000):
        texts[p] = pick.randrange(1, 50)
        rows |= {(p, s): texts[p] for s in pick.sample(names, pick.randrange(1, 6))}
    whole = sum(texts.values())
    once = mixing.route(texts, rows, dict.fromkeys(names, whole / 60))
    twice = mixing.route(texts, rows, dict.fromkeys(names, whole / 20))
    by = lambda flow: [sum(flow[k] for k in rows if k[0] == p) for p in texts]
    for flow, quota, times in ((once, whole / 60, 1), (twice, whole / 20, 2)):
        assert all(sum(flow[k] for k in rows if k[1] == s) == pytest.approx(quota) for s in names)
        assert all(given <= times * texts[p] + 1e-6 for p, given in enumerate(by(flow)))
    assert sum(min(g, t) for g, t in zip(by(twice), texts.values(), strict=True)) == pytest.approx(whole, rel=1e-6)
