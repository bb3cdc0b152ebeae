import math
import zlib
from collections import Counter

from roundwise.llm import langid


def brute(rows, text):
    """The same rule from counts, word by word. rows: language, text."""
    words = langid.WORD.findall((text or "").lower())
    if not words:
        return "und"
    langs = sorted({x for x, _ in rows})
    counts = {x: Counter(w for y, t in rows if y == x for w in langid.WORD.findall(t.lower())) for x in langs}
    grams = {k: {x: Counter() for x in langs} for k in langid.ORDERS}
    for k in langid.ORDERS:
        for x in langs:
            for w, n in counts[x].items():
                m = f" {w} "
                for i in range(len(m) - k + 1):
                    grams[k][x][m[i : i + k]] += 1 + math.log(n)

    def logs(of, key):
        every = len(set().union(*of.values()))
        return [math.log((of[x][key] + 0.5) / (sum(of[x].values()) + 0.5 * every)) for x in langs]

    total = [0.0] * len(langs)
    for w, n in Counter(words).items():
        row = [0.0] * len(langs)
        if any(w in counts[x] for x in langs):
            row = logs(counts, w)
        else:
            for k in langid.ORDERS:
                m = f" {w} "
                hits = [logs(grams[k], m[i : i + k]) for i in range(len(m) - k + 1) if any(m[i : i + k] in grams[k][x] for x in langs)]
                if hits:
                    row = [sum(h[j] for h in hits) / len(hits) for j in range(len(langs))]
                    break
        total = [t + n * x for t, x in zip(total, row, strict=True)]
    return langs[max(range(len(total)), key=lambda i: (total[i], -i))]


EN = "the cat sat on the mat and the dog ran with her to that house"
DE = "der hund und die katze sind nicht auf der straße mit einem schönen haus"


def test_backoff_agrees_with_brute_force(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.learn(docs, ~langid.held_out(docs.doc_id, 3, 1))
    seen = [(x, t) for i, t, x, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    odd = [(100, None), (101, ""), (102, "12 ... !"), (103, "straßen hunde"), (104, "houses mats THE"), (105, "Ω"), (None, EN * 2000)]
    got = langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == [brute(seen, t) for _, t in odd]
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[3].lang_pred == "de" and got[4].lang_pred == "en"
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs, ~langid.held_out(docs.doc_id, 3, 1))
    assert langid.predict(docs, model).first().lang_pred == "und"


def test_rare_languages_marks_ties_and_empty_tables(spark):
    """A language of one row is learned beside a large one; vowel signs belong to
    their words; equal languages tie by name; repeated and null ids are rows."""
    rows = [(i, EN + f" w{i}x", "en") for i in range(60)] + [(200, "नमस्ते दुनिया के लोग", "hi"), (301, "qqq zzz", "b"), (304, "qqq zzz", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, langid.F.lit(True))
    assert model.langs == ["a", "b", "en", "hi"] and "नमस्ते" in model.words.index and len(model.words.index) == len({w for _, t, _ in rows for w in langid.WORD.findall(t)})
    odd = spark.createDataFrame([(1, "दुनिया"), (1, "दुनिया"), (None, "qqq"), (2, "w77x the")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(odd, model).collect()] == ["hi", "hi", "a", "en"]
    assert langid.predict(odd.limit(0), model).count() == 0
    assert langid.learn(docs.limit(0), langid.F.lit(True)).langs == []
