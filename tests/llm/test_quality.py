import random
import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from roundwise.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    w = re.findall(WORD, text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    n = len(covered)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)


def test_features_equal_brute_force(spark):
    pick = random.Random(8)
    texts = [None, "", " \n\t", "a b c a b c", "é\n\né\x0b x\n é", "x " * 3000, "***\n***\n|"]
    texts += ["".join(pick.choice(["a", "b", "#", " ", "\n", "Ω", "\r", "c "]) for _ in range(pick.randrange(400))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, _qwords int")
    got = quality.with_features(docs).select("doc_id", "_quality.*").collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


def test_binomial_tail_is_exact(spark):
    rows = [(n, k) for n in (0, 1, 10, 500) for k in range(0, 8) if k <= n]
    df = spark.createDataFrame(rows, "n long, k long")
    for n, k, p in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.02)).collect():
        want = sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) if k < n * 0.02 else 1
        assert p == pytest.approx(want)


def test_cutoffs_limit_false_rejection(spark):
    pick = random.Random(2)
    good = [(i, " ".join(f"w{pick.randrange(9999)}" for _ in range(80)), "en") for i in range(3000)]
    bad = [(5000 + i, " ".join(f"w{pick.randrange(9999)}***" for _ in range(80)), "en") for i in range(200)]
    few = [(9000 + i, " ".join(f"w{pick.randrange(9999)}***" for _ in range(80)), None) for i in range(20)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good + few] + [(i, 0) for i, _, _ in bad], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(spark, docs, labels).collect()}
    assert sum(not got[i].kept for i, _, _ in good) <= 0.02 * len(good)
    assert not any(got[i].kept for i, _, _ in bad) and all(got[i].kept for i, _, _ in few)
    kept = quality.keep(spark, docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    none = quality.judge(spark, docs.limit(3), labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none) and quality.judge(spark, docs.limit(0), labels).count() == 0


def brute_depths(rows, labels, risk=quality.Risk()):
    """rows: doc_id, stratum, base_failed, step (null: none)."""
    good = {i for i, q in labels if q == 1}
    worst = {}
    for i, s, failed, step in rows:
        if i in good and not failed:
            worst.setdefault(s, {})
            worst[s][i] = min(worst[s].get(i, 99), 99 if step is None else step)
    level = risk.delta / (len(worst) + 1)
    pools = {}
    for s, of in worst.items():
        pools.setdefault(s if (1 - risk.alpha) ** len(of) <= level else None, []).extend(of.values())
    deep = {}
    for p, steps in pools.items():
        n, deep[p] = len(steps), 0
        for i in range(len(quality.CHAIN)):
            k = sum(x <= i for x in steps)
            if k >= n * risk.alpha or sum(comb(n, j) * risk.alpha**j * (1 - risk.alpha) ** (n - j) for j in range(k + 1)) > level:
                break
            deep[p] = i + 1
    return {s: deep[s if s in pools else None] for s in worst}


def test_depths_equal_brute_force(spark):
    pick = random.Random(5)
    rows, labels = [], []
    for s, n, share in (("a", 900, 0.002), ("b", 400, 0.0), ("c", 120, 0.0), ("d", 140, 0.0), ("e", 260, 0.004), ("", 3, 0.0)):
        for _ in range(n):
            i = len(rows)
            rows.append((i, s, pick.random() < 0.1, pick.randrange(len(quality.CHAIN)) if pick.random() < share * 20 else None))
            labels += [(i, 1)] * pick.choice([0, 1, 1, 1, 5]) + [(i, 0)] * pick.randrange(2)
    rows += [(0, "a", False, 3)] * 4 + [(None, "a", False, 0)]
    got = quality.depths(spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, step int"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.stratum: r.depth for r in got.collect()}
    assert got == brute_depths(rows, labels) and got["b"] == len(quality.CHAIN) and 0 < got["a"] < len(quality.CHAIN) and got["c"] == got["d"] == got[""]


def test_labels_that_are_repeated_count_once(spark):
    """40 good documents labelled 30 times each are 40 trials, too few for a rule."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(40)] + [(99, " ".join(f"***{j}" for j in range(60)), "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] * 30, "doc_id long, quality int")
    assert all(r.kept for r in quality.judge(spark, docs, labels).collect())


def test_large_tables_take_the_same_decisions(spark, monkeypatch):
    """Without broadcasts of labelled ids and of depths, the same rows stay."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" + "***" * (i % 5 == 0) for j in range(60)), "en" if i % 2 else None) for i in range(600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(600)], "doc_id long, quality int")
    few = sorted(r.doc_id for r in quality.keep(spark, docs, labels).collect())
    monkeypatch.setattr(quality, "LABELS", 0)
    monkeypatch.setattr(quality, "FEW", 0)
    assert sorted(r.doc_id for r in quality.keep(spark, docs, labels).collect()) == few and 0 < len(few) < 600
