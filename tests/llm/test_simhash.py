import random

import numpy as np
import xxhash

from roundwise.llm import simhash, similar

M = (1 << 64) - 1


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))]


def test_fingerprints():
    pick = random.Random(5)
    texts = [None, "", " \n", "One", "one TWO", "É a b c d"]
    texts += [" ".join(pick.choice("aA bB c\t é the of x".split(" ")) for _ in range(pick.randrange(80))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def test_thresholds_cover_every_pair_within_the_limit():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64)
    for n in (10, 10**4, 10**7, 10**10):
        used = simhash.plan(sample, n)
        assert sum(t + 1 for _, t in used) == simhash.LIMIT + 1
        assert len({b for bits, _ in used for b in bits}) == sum(len(bits) for bits, _ in used)


def test_components_equal_brute_force(spark):
    pick = random.Random(3)
    prints = [pick.getrandbits(64) for _ in range(60)]
    for _ in range(240):  # chains of small steps
        x = pick.choice(prints)
        for b in pick.sample(range(64), pick.choice([0, 1, 2, 3, 4, 5])):
            x ^= 1 << b
        prints.append(x)
    prints += [0, 0, 7, M]
    ids = pick.sample(range(10_000), len(prints))
    rows = spark.createDataFrame([(i, simhash.signed(p)) for i, p in zip(ids, prints, strict=True)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.classes(rows).collect()}
    assert [got[i] for i in ids] == brute_classes(ids, prints)


def test_dedup_keeps_columns_and_one_of_each(spark):
    a = " ".join(f"w{i}" for i in range(80))
    rows = [(5, a, 1), (3, a.upper(), 2), (3, a, 2), (9, None, 3), (8, " ", 4), (None, "zz yy", 5), (7, "other words here at all", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = simhash.dedup(spark, docs)
    assert got.columns == docs.columns and sorted(map(str, (r.doc_id for r in got.collect()))) == ["3", "7", "8", "None"]
    assert simhash.dedup(spark, docs.limit(0)).count() == 0


def test_dedup_loses_no_text_that_differs(spark):
    """Components are told apart by fingerprints, not by ids: null and repeated ids."""
    pick = random.Random(8)
    texts = [" ".join(f"{w}{pick.randrange(10**6)}" for _ in range(60)) for w in "abcdefgh"]
    ids = [None, None, 1, 1, 1, 2, 2, None]
    rows = [*zip(ids, texts, strict=True), (None, texts[0].upper()), (1, texts[2].upper()), (9, texts[3]), (2, texts[5]), (2, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for dedup in (simhash.dedup, similar.dedup):
        got = dedup(spark, docs).collect()
        assert sorted(r.text.lower() for r in got) == sorted(texts)
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, ids))


def test_dense_ball_and_hot_bucket(spark):
    """Many fingerprints within few bits of each other, in buckets that are split."""
    pick = random.Random(6)
    base = pick.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(7))) for _ in range(250)})
    rows = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.classes(rows).collect()}
    assert [got[i] for i in range(len(prints))] == brute_classes(list(range(len(prints))), prints)
