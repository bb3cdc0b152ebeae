import random
import re
import time

from pyspark.sql import functions as F

from roundwise.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    return {"email": True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    return sorted((m.start(), i, m.end()) for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text or "") if ok(k, m[0]))


PARTS = ["a@b.c", "_d@e.f", "x.y+z@mail-1.example.com", "@", "1.2.3.4", "255.255.0.1", "300.1.1.1", "000012.1.1.1", ".5.6.7", "4111111111111111", "4111 1111-1111 1111", "4111111111111112", "0", " ", "-", "\n", "é", "🎉", "+1 (499) 555-6503", "+44.20.7946.0018", "+", "word", "9" * 25, "."]


def test_spans_equal_plain_expressions(spark):
    pick = random.Random(4)
    texts = [None, "", "a" * 20000, "1." * 9000, "a@b" + ".c" * 9000, "5 " * 9000, "+1" + " " * 5000]
    texts += ["".join(pick.choice(PARTS) for _ in range(pick.randrange(14))) for _ in range(700)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _spans_x int")
    none = spark.createDataFrame([], "pattern string")
    got = {r.doc_id: [tuple(x) for x in r.s] for r in pii.with_spans(docs, none, into="s").select("doc_id", "s").collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def contexts():
    rows = [(i, f"please call +1 (499) 555-65{i:02d} now") for i in range(12)] + [(50 + i, f"badge AB{i}00{i}77 is number {i}5x5x5x") for i in range(5)]
    return rows + [(100, "call QX99-1234-77 today"), (101, "item 77-88-99-11 only"), (102, None)]


def test_bootstrap_finds_unseen_identifiers(spark):
    docs = spark.createDataFrame(contexts(), "doc_id long, text string")
    assert [r.pattern for r in pii.trusted(docs).collect()] == ["call"]
    joined = pii.with_spans(docs, pii.trusted(docs)).select("doc_id", pii.joined(F.col("_spans")).alias("s")).collect()
    got = {r.doc_id: r.s for r in joined}
    assert got[100] == "id:5:17" and got[101] == got[102] == got[50] == "" and got[3] == "phone:12:29"
    many, pii.FEW = pii.FEW, 0
    try:
        again = pii.with_spans(docs, pii.trusted(docs)).select("doc_id", pii.joined(F.col("_spans")).alias("s")).collect()
    finally:
        pii.FEW = many
    assert {r.doc_id: r.s for r in again} == got


def brute_scores(edges, rounds=pii.ROUNDS):
    seeds = {i for _, i, s in edges if s}
    score = {i: float(i in seeds) for _, i, _ in edges}
    before = None
    for _ in range(rounds):
        of = {p: [i for q, i, _ in edges if q == p] for p, _, _ in edges}
        pattern = {p: sum(score[i] for i in x) / (1 + len(x)) for p, x in of.items()}
        good = {p for p, x in of.items() if pattern[p] >= pii.HIGH and sum(score[i] >= pii.HIGH for i in x) >= pii.SEEDS}
        if good == before:
            break
        before = good
        for i in score:
            left = 1.0
            for p in good:
                left *= 1 - pattern[p] if i in of[p] else 1
            score[i] = 1.0 if i in seeds else 1 - left
    return pattern, good


def hops():
    """Seeds make one trusted, what it finds makes two trusted, and that three."""
    edges = [("one", f"s{i}", True) for i in range(100)] + [("one", f"f{i}", False) for i in range(8)]
    edges += [("two", f"f{i}", False) for i in range(8)] + [("three", f"g{i}", False) for i in range(9)] + [("three", "f0", False)]
    return edges + [("half", f"s{i}", True) for i in range(6)] + [("half", f"h{i}", False) for i in range(6)]


def test_scores_equal_brute_force(spark):
    few = [("p", "a", True), ("p", "b", True), ("p", "c", False), ("q", "c", False), ("q", "d", False), ("r", "a", True)]
    for edges in (few, hops()):
        pattern, _ = brute_scores(edges)
        got = {r.pattern: r.score for r in pii.scores(spark.createDataFrame(edges, "pattern string, instance string, seed boolean")).collect()}
        assert got.keys() == pattern.keys() and all(abs(got[p] - pattern[p]) < 1e-9 for p in pattern)
    assert brute_scores(hops())[1] == {"one", "two"}


def test_second_hop_patterns_are_found(spark):
    rows = [f"dial +1 (499) 555-65{i:02d} now" for i in range(100)] + [f"dial KX-{i}{i}-4711{i} now" for i in range(8)]
    rows += [f"badge KX-{i}{i}-4711{i}" for i in range(8)] + ["badge ZZ-99-00001 here", "lot AB-12-345678"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.pattern for r in pii.trusted(docs).collect()) == ["badge", "dial"]
    got = {r.doc_id: r.s for r in pii.with_spans(docs, pii.trusted(docs)).select("doc_id", pii.joined(F.col("_spans")).alias("s")).collect()}
    assert len(rows) == 118 and got[108] == "id:6:17" and got[116] == "id:6:17" and got[117] == ""


def test_many_matches_in_one_text_take_linear_time(spark):
    n = 40_000
    text = " ".join(f"u{i}@x.org" for i in range(n))
    docs = spark.createDataFrame([(1, text, 1), (2, None, 1), (1, text[:8], 1)], "doc_id long, text string, lang int")
    began = time.time()
    out = pii.redact(docs).collect()
    assert out[0].text == " ".join(["<EMAIL>"] * n) and out[2].text == "<EMAIL>" and out[1].text is None
    assert time.time() - began < 60


def test_redaction_over_pieces_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(pii, "CHUNK", 3)
    pick = random.Random(11)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randrange(40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for a, k, b in brute(t):
            if a >= at:
                out += t[at:a] + f"<{pii.KINDS[k].upper()}>"
            at = max(at, b)
        assert got[i] == out + t[at:], t


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "x@y.z"), (1, "x@y.z"), (None, None)], "doc_id long, text string")
    got = pii.with_spans(docs, pii.trusted(docs)).select("doc_id", pii.joined(F.col("_spans")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in got) == [("1", "email:0:5"), ("1", "email:0:5"), ("None", "")]
    assert pii.redact(docs.limit(0)).count() == 0 and pii.trusted(docs.limit(0)).count() == 0


def test_redaction_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", "mail a@b.c or 4111111111111111."), (1, "b", None)], "doc_id long, _cut string, text string")
    got = pii.redact(docs)
    assert got.columns == docs.columns and [r.text for r in got.collect()] == ["mail <EMAIL> or <CARD>.", None]
