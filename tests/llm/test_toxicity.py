import random
from itertools import combinations

import numpy as np

from roundwise.llm import toxicity as tox


def brute(word):
    """Weighted subsequences of the marked word, by their letters."""
    marked, out = "^" + word + "$", {}
    for n in (3, 4):
        for at in combinations(range(len(marked)), n):
            span = at[-1] - at[0]
            if span < tox.SPAN:
                key = tuple(marked[i] for i in at)
                out[key] = out.get(key, 0) + tox.DECAY ** (span - n + 1)
    return out


def test_kernel_equals_brute_force():
    words = ["stupid", "stxupid", "stupi", "anana", "abc", "réeux"]
    got = tox.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = brute(a), brute(b)
            norm = lambda v: sum(t * t for t in v.values()) ** 0.5
            want = sum(x[k] * y.get(k, 0) for k in x) / norm(x) / norm(y)
            assert abs(got[i, j] - want) < 2e-2  # hashed places may meet


def test_tokens_of_gapped_words():
    assert tox.cleaned("s.t*u-p.i.d!") == ["stupid"] and tox.cleaned("...") == []
    assert "stupid" in tox.sentences("really. S t u p i d really")[1] and "stupid" in tox.tokens("so S t u p i d really")
    assert tox.sentences("One two. Yes!\nno.net") == [["one", "two"], ["yes"], ["no.net"]]
    assert max(map(len, tox.cleaned("x" * 1000))) == tox.WIDTH


def corpus(n, seed):
    pick = random.Random(seed)
    clean = ["".join(pick.choice(["th", "er", "on", "an", "re"]) for _ in range(3)) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [pick.choice(clean) for _ in range(40)]
        if i % 4 == 0:
            words[3::12] = [pick.choice(["grubhead", "snotface"]) for _ in words[3::12]]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_held_out_and_odd_rows(spark):
    model = tox.fit([(y, t) for _, t, y in corpus(400, 1)])
    held = corpus(100, 2)
    got = model.score_all([t for _, t, _ in held])
    assert np.mean([(s >= 0.3) == (y == 1) for s, (_, _, y) in zip(got, held, strict=True)]) > 0.95
    texts = [None, "", "12 34", "grubxhead snottface here", "g r u b h e a d and s.n.o.t.f.a.c.e"]
    odd = spark.createDataFrame([(1, t, 0.5) for t in texts], "doc_id long, text string, score double")
    scored = [r.score for r in tox.score(odd, model).collect()]
    assert scored[0] == scored[1] == scored[2] < 0.3 and min(scored[3:]) >= 0.3
    assert tox.fit([]).score_all(["x"])[0] < 0.3


def test_empty_tables_and_long_texts(spark):
    """Nothing to learn from, nothing to score, a text of a million words, ties."""
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in corpus(120, 3)] + [(None, "grubhead", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus(120, 3)] * 2 + [(None, 1)], "doc_id long, toxic int")
    everything = tox.F.lit(True)
    model = tox.learn(docs, labels, everything)
    long = [("a", "thon rean " * 500_000 + "grubhead snotface"), ("a", "thon rean " * 500_000), ("b", "grubhead snotface"), ("b", "grubhead snotface")]
    got = [r.score for r in tox.score(spark.createDataFrame(long, "doc_id string, text string"), model).collect()]
    assert got[0] >= 0.3 > got[1] and got[2] == got[3] >= 0.3
    assert tox.score(docs.limit(0), model).count() == 0
    blank = tox.learn(docs, labels.limit(0), everything)
    assert blank.score_all(["grubhead snotface", None])[0] < 0.3


def test_scores_equal_brute_force():
    """A document's score from the weights of its words' subsequences, one by one."""
    model = tox.fit([(y, t) for _, t, y in corpus(200, 5)])

    def margin(word):
        total = 0.0
        p, w = tox.subsequences([word])
        for place, weight in zip(p[0], w[0], strict=True):
            total += model.weights[place] * weight
        return max(-3.0, total + model.bias)

    for _, t, _ in corpus(20, 6) + [(0, "Grub-head! s n o t f a c e, well", 1), (0, "", 0)]:
        best = {}
        for token in tox.tokens(t):
            m, word = max(((margin(w), w) for w in tox.cleaned(token)), default=(-3.0, ""))
            best[word] = m
        top = [-3.0, -3.0, *sorted(best.values())][-2:]
        a, b, c = model.curve
        assert abs(model.score_all([t])[0] - 1 / (1 + np.exp(-(a + b * top[1] + c * top[0])))) < 1e-9
