"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two words is the inner product of their weighted subsequences of
three and four letters, gaps allowed up to SPAN letters, each skipped letter
halving the weight; it is normalised. So inserted letters, joined suffixes and
gaps leave words similar; letters spelt apart are run together first. Landmarks
span the model: a word's features are its kernel values with them, whitened. A
linear SVM on those folds into one weight a subsequence (hashed to 2**HASH places),
so scoring a word needs no landmark. A sentence's margin is that of its highest word.

Training data are sentences of labelled documents, of which only the document's
label is known. A clean document's sentences are all negative, so all their words
are. Of a toxic one some sentence is positive: first the one whose word is most
above its frequency in clean documents is the witness, then rounds of training
choose the highest sentences anew (multiple-instance learning). A logistic curve over
the margins of a document's two highest words, whichever sentences hold them, gives
its score: a clean sentence may hold one word that is like an insult by chance.

The fit sees a bounded sample: about SAMPLE labelled documents of each label and
SAMPLE_CHARS characters of each at most, picked by a hash of the id; it uses all
sentences of those. Defined results: a text without letters, or a model without
toxic labels, gets the base score; repeated and null ids are rows like others (null
ids are not learned from, nor held out); long tokens are scored in overlapping
windows, so texts are read to their end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundwise.llm.common import pieces, table
from roundwise.llm.langid import held_out

SAMPLE, SAMPLE_CHARS = 2500, 30_000_000
LANDMARKS = 96
#: Sentences of a toxic document that are positive, at most.
WITNESSES = 2
#: Weight of all positives to that of all negatives.
BALANCE = 0.15
HASH = 18
SPAN, WIDTH, STEP = 6, 24, 12
#: Rows of the training table that a step copies.
ROWS = 8192
DECAY = 0.5
#: Tokens that a worker keeps, and the longest of them.
MEMO, LONG = 600_000, 64
#: A word is told from chance by twice the log-likelihood ratio of its counts.
LIFT = 8.0
#: Words of a sentence at most; longer ones are cut.
SENTENCE = 40
ENDS = re.compile(r"[.!?;\n]+(?=\s|$)")
SPACED = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")
PIECES = re.compile(r"[^\W\d_]+")

_OFFSETS = [(0, *rest) for n in (3, 4) for rest in combinations(range(1, SPAN), n - 1)]


def codes(words: list[str]) -> np.ndarray:
    """A row a word: codes of its characters with marks at both ends, 0 after."""
    longest = min(WIDTH, max(map(len, words), default=0))
    out = np.zeros((len(words), max(SPAN, longest + 2)), np.int64)
    for i, w in enumerate(words):
        w = w[:WIDTH]
        out[i, 0] = 1
        out[i, 1 : len(w) + 1] = np.frombuffer(w.encode("utf-32-le"), "<u4")
        out[i, len(w) + 1] = 2
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of each word's subsequences; weight 0 where there is
    none. Equal places within a word are merged, and rows have norm 1."""
    c = codes(words)
    n = c.shape[1]
    places, weights = [], []
    for offsets in _OFFSETS:
        last = n - offsets[-1]
        h = np.zeros((len(words), last), np.uint64)  # last >= 1, as rows are SPAN wide at least
        for o in offsets:
            h = (h ^ c[:, o : o + last].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        places.append((h >> np.uint64(64 - HASH)).astype(np.int32))
        weights.append(np.where(c[:, offsets[-1] : offsets[-1] + last] > 0, DECAY ** (offsets[-1] - len(offsets) + 1), 0.0))
    p, w = np.concatenate(places, axis=1), np.concatenate(weights, axis=1)
    p = np.where(w > 0, p, -1)
    order = np.argsort(p, axis=1, kind="stable")
    p, w = np.take_along_axis(p, order, 1), np.take_along_axis(w, order, 1)
    new = np.ones_like(p, bool)
    new[:, 1:] = p[:, 1:] != p[:, :-1]
    flat = np.flatnonzero(new.ravel())
    sums = np.add.reduceat(w.ravel(), flat) if len(flat) else np.zeros(0)
    merged = np.zeros(p.size)
    merged[flat] = sums
    merged = merged.reshape(p.shape)
    norm = np.sqrt((merged**2).sum(axis=1, keepdims=True))
    return np.where(p < 0, 0, p), merged / np.maximum(norm, 1e-12)


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    dense = np.zeros((1 << HASH, len(others)), np.float32)
    p, w = subsequences(others)
    np.add.at(dense, (p, np.arange(len(others))[:, None]), w)
    out = np.zeros((len(words), len(others)), np.float32)
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    for at in range(0, len(words), 500):  # words of like length together: narrow tables
        some = order[at : at + 500]
        p, w = subsequences([words[i] for i in some])
        sums = np.zeros((len(some), len(others)), np.float32)
        for j in np.flatnonzero((w > 0).any(axis=0)):
            used = w[:, j] > 0
            sums[used] += w[used, j, None].astype(np.float32) * dense[p[used, j]]
        out[some] = sums
    return out


def cleaned(token: str) -> list[str]:
    """The words to score for a token: its letters run together, and each piece
    between other characters; windows of long ones."""
    pieces = PIECES.findall(token)
    found = list(dict.fromkeys(["".join(pieces), *[x for x in pieces if len(x) > 2]])) if pieces else []
    out = []
    for w in found:
        out += [w] if len(w) <= WIDTH else [w[i : i + WIDTH] for i in range(0, len(w) - STEP, STEP)]
    return [w for w in out if len(w) > 2]


def sentences(text: str | None) -> list[list[str]]:
    """The tokens of each sentence, in lower case; letters spelt apart are one."""
    out = []
    for part in ENDS.split((text or "").lower()):
        found = part.split() + ["".join(m.split()) for m in SPACED.findall(part)]
        out += [found[i : i + SENTENCE] for i in range(0, len(found), SENTENCE)]
    return out


def tokens(text: str | None) -> set[str]:
    """The tokens of all sentences."""
    low = (text or "").lower()
    return {*low.split(), *["".join(m.split()) for m in SPACED.findall(low)]}


def highest(bag: list[list[str]], of) -> list[tuple[float, str]]:
    """The highest word of each sentence, once a word, in falling order."""
    best = {}
    for words in bag:
        if words:
            m, w = max((of(w), w) for w in words)
            best[w] = m
    return sorted(((m, w) for w, m in best.items()), reverse=True)


@dataclass
class Model:
    weights: np.ndarray  # of each place
    bias: float
    curve: tuple[float, float, float]  # constant, highest and second margin
    memo: dict[str, tuple[str, float]] = field(default_factory=dict)  # token to its highest word

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for at in range(0, len(words), 1000):  # words of like length together: narrow tables
            some = order[at : at + 1000]
            p, w = subsequences([words[i] for i in some])
            out[some] = (self.weights[p] * w).sum(axis=1)
        return np.maximum(out + self.bias, -3.0)

    def score_all(self, texts: list[str | None]) -> list[float]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        found = [tokens(t) for t in texts]
        missing = list(set().union(*found) - self.memo.keys())
        parts = [cleaned(t) for t in missing]
        distinct = list(dict.fromkeys(w for x in parts for w in x))
        of = dict(zip(distinct, self.margins(distinct).tolist(), strict=True))
        for t, x in zip(missing, parts, strict=True):
            if len(x) == 1:
                self.memo[t] = (x[0], of[x[0]])
            else:
                m, w = max(((of[w], w) for w in x), default=(-3.0, ""))
                self.memo[t] = (w, m)
        get = self.memo.__getitem__
        out = [self.score(sorted(dict(map(get, x)).values())[-2:]) for x in found]
        for t in missing:
            if len(t) > LONG:
                del self.memo[t]
        return out

    def score(self, top: list[float]) -> float:
        top = [-3.0, -3.0, *top]
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * top[-1] + c * top[-2], -50, 50))))


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last feature is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        miss = 1 - y * (x @ w)
        on = miss > 0
        grad, hess = w.copy(), np.eye(len(w))
        for at in range(0, len(x), ROWS):  # no copy of the whole table
            part = slice(at, at + ROWS)
            some, c = x[part][on[part]], cost[part][on[part]]
            grad -= some.T @ (c * y[part][on[part]] * miss[part][on[part]]) * 2
            hess += 2 * (some * c[:, None]).T @ some
        w = w - np.linalg.solve(hess, grad)
    return w


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (y - p) - 0.05 * w)
    return w


def fit(rows: list[tuple[int, str | None]]) -> Model:
    """rows: label (1 toxic) and the document's text."""
    bags = [(y, [list(dict.fromkeys(w for t in s for w in cleaned(t))) for s in sentences(text)]) for y, text in rows]
    toxic, clean = [b for y, b in bags if y], [b for y, b in bags if not y]
    none = Model(np.zeros(1 << HASH), -3.0, (float(np.log((len(toxic) + 0.5) / (len(clean) + 10))), 0.0, 0.0))
    if not toxic or not clean:
        return none
    bad, good = (Counter(w for b in some for w in {w for s in b for w in s}) for some in (toxic, clean))
    lift = {w: n * np.log((n / len(toxic)) / ((good[w] + 0.5) / len(clean))) for w, n in bad.items()}
    ranked = sorted((w for w in bad if bad[w] > 1 and 2 * lift[w] >= LIFT), key=lambda w: (-lift[w], w))
    if not ranked:
        return none
    negatives = sorted(good)
    near = negatives[:: max(1, len(negatives) // (LANDMARKS // 3))]
    marks = list(dict.fromkeys([*ranked[: 2 * LANDMARKS // 3], *near]))[:LANDMARKS]
    gram = kernel(marks, marks).astype(float)
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6
    white = vectors[:, keep] / np.sqrt(values[keep])
    at, weight = subsequences(marks)

    def model_of(w: np.ndarray, curve: tuple[float, float, float]) -> Model:
        """The weights of landmarks folded into those of subsequences."""
        weights = np.zeros(1 << HASH)
        np.add.at(weights, at, weight * (white @ w[:-1])[:, None])
        return Model(weights, float(w[-1]), curve)

    def features(words: list[str]) -> np.ndarray:
        out = np.ones((len(words), white.shape[1] + 1))
        np.matmul(kernel(words, marks), white, out=out[:, :-1])
        return out

    clean_rows = features(negatives)
    words = sorted(bad)
    of = lift
    for _ in range(3):
        chosen = {w for b in toxic for m, w in highest(b, of.__getitem__)[:WITNESSES] if m > 0 and not good[w]}
        pos = sorted(chosen)
        x = np.concatenate([features(pos), clean_rows])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(negatives))])
        cost = np.concatenate([np.array([1.0 * min(20, bad[v]) for v in pos]), np.ones(len(negatives))])
        cost[: len(pos)] *= BALANCE * len(negatives) / cost[: len(pos)].sum()
        model = model_of(svm(x, y, cost), (0.0, 1.0, 0.0))
        of = dict(zip(words, model.margins(words).tolist(), strict=True))
    every = sorted(set(bad) | set(good))
    of = dict(zip(every, model.margins(every).tolist(), strict=True))
    tops = np.array([([-3.0, -3.0, *sorted(of[w] for w in {w for s in b for w in s})])[-2:][::-1] for _, b in bags])
    a, b, c = logistic(tops, np.array([float(y) for y, _ in bags]))
    return Model(model.weights, model.bias, (float(a), float(b), float(c)))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Labels of learnable ids; at most about sample documents of each label, and
    chars characters of each."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learnable).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars")).join(known, "doc_id").groupBy("toxic")
    limit = {r["toxic"]: min(sample / r["n"], chars / max(1, r["chars"])) for r in sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).collect()}
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000)) / 1e6
    ids = known.where(share < F.when(F.col("toxic") == 1, limit.get(1, 0.0)).otherwise(limit.get(0, 0.0)))
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # about twice sample ids
    rows = picked.select("toxic", "text").collect()
    return fit(sorted((r["toxic"], r["text"] or "") for r in rows))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = sent.value.score_all(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got, pa.float64())], names=[*keep, "score"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "score double"])
    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text_")).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
