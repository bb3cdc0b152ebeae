"""Language identification by word-first backoff.

A known word adds its log frequency in each language. An unseen word falls back
to character n-grams: the longest order of which any n-gram is known decides, by
the mean log frequency of its known n-grams. Words count equally; they are runs of
letters and the marks that go with them.

The model is fitted on a bounded sample: of each language about SAMPLE rows, or of
many languages ROWS / languages each, picked by a hash of their id. All words of
those rows are kept, and the tables hold only counts that are there, so what a
model takes follows the sample and neither the corpus nor the number of languages.

Defined results: null text, or one without a letter, is "und" with score 0; so is
everything if nothing can be learned. Null ids are not held out and not learned
from. Ties go to the language whose name sorts first.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundwise.llm.common import pieces, table

SAMPLE, ROWS = 3000, 60_000
ORDERS = (4, 3, 2, 1)
#: Bytes that a worker keeps of the words it has met.
MEMO = 96 << 20
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class Table:
    """Log frequencies of keys in each language, add-half smoothed: a base for keys
    a language doesn't have, and for those it has what they add."""

    def __init__(self, counts: dict[str, dict[str, float]], langs: list[str]):
        """counts: language to key to count."""
        every = sorted(set().union(*counts.values())) if counts else []
        self.index = {k: i for i, k in enumerate(every)}
        sums = np.array([sum(counts[x].values()) + 0.5 * len(every) for x in langs])
        self.base = np.log(0.5) - np.log(np.maximum(sums, 0.5))
        key = np.concatenate([np.zeros(0, np.int64), *[np.fromiter((self.index[k] for k in counts[x]), np.int64, len(counts[x])) for x in langs]])
        lang = np.concatenate([np.zeros(0, np.int32), *[np.full(len(counts[x]), i, np.int32) for i, x in enumerate(langs)]])
        more = np.concatenate([np.zeros(0), *[np.log(np.fromiter(counts[x].values(), float, len(counts[x])) + 0.5) - np.log(0.5) for x in langs]])
        order = np.argsort(key, kind="stable")
        self.lang, self.more = lang[order], more[order].astype(np.float32)
        self.start = np.searchsorted(key[order], np.arange(len(every) + 1))

    def rows(self, numbers: np.ndarray) -> np.ndarray:
        """A row of log frequencies for each number of a key."""
        out = np.tile(self.base, (len(numbers), 1))
        first, size = self.start[numbers], self.start[numbers + 1] - self.start[numbers]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out[np.repeat(np.arange(len(numbers)), size), self.lang[at]] += self.more[at]
        return out

    def find(self, keys: list[str]) -> np.ndarray:
        """The numbers of keys; -1 for those that no language has."""
        get = self.index.get
        return np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: dict[int, Table]
    memo: dict[str, int] | None = None  # word to its row of scores
    scores: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None, "scores": None}

    def rows(self, words: list[str]) -> np.ndarray:
        """The scores of words in each language."""
        out = np.zeros((len(words), len(self.langs)))
        known = self.words.find(words)
        out[known >= 0] = self.words.rows(known[known >= 0])
        left = np.flatnonzero(known < 0)
        for n in ORDERS:
            rest = []
            step = max(1, (1 << 20) // (len(self.langs) + 20))
            for at in range(0, len(left), step):
                some = left[at : at + step]
                marked = [f" {words[i]} " for i in some]
                held = [[m[i : i + n] for i in range(len(m) - n + 1)] for m in marked]
                number = self.grams[n].find([g for x in held for g in x])
                owner = np.repeat(np.arange(len(some)), [len(x) for x in held])[number >= 0]
                hits = np.bincount(owner, minlength=len(some))
                found = self.grams[n].rows(number[number >= 0])
                sums = np.column_stack([np.bincount(owner, found[:, j], len(some)) for j in range(len(self.langs))])
                out[some[hits > 0]] = sums[hits > 0] / hits[hits > 0, None]
                rest.append(some[hits == 0])
            left = np.concatenate([np.zeros(0, np.int64), *rest])
        return out

    def meet(self, words: set[str]) -> None:
        """Makes rows for words; what is kept of them takes about MEMO bytes."""
        if self.memo is None or len(self.memo) * (8 * len(self.langs) + 150) > MEMO:
            self.memo, self.scores = {}, np.zeros((0, len(self.langs)))
        new = sorted(words - self.memo.keys())
        if new:
            first = len(self.scores)
            self.scores = np.concatenate([self.scores, self.rows(new)])
            self.memo.update((w, first + i) for i, w in enumerate(new))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        held = [WORD.findall((t or "").lower()) for t in texts]
        self.meet({w for words in held for w in words})
        out = []
        for words in held:
            if not words:
                out.append(("und", 0.0))
                continue
            total = np.zeros(len(self.langs))
            for at in range(0, len(words), 100_000):
                total += self.scores[list(map(self.memo.__getitem__, words[at : at + 100_000]))].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
        return out


def fit(rows: list[tuple[str, str, int]]) -> Model:
    """rows: language, word, count."""
    words: dict[str, Counter] = defaultdict(Counter)
    grams: dict[int, dict[str, Counter]] = {n: defaultdict(Counter) for n in ORDERS}
    for lang, w, n in rows:
        words[lang][w] += n
        marked = f" {w} "
        weight = 1 + math.log(n)  # frequent words shall not drown the rest
        for k in ORDERS:
            c = grams[k][lang]
            for i in range(len(marked) - k + 1):
                c[marked[i : i + k]] += weight
    langs = sorted(words)
    return Model(langs, Table(words, langs), {k: Table(grams[k], langs) for k in ORDERS})


def held_out(key: Column, mod: int, out: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % mod == out, F.lit(False))


def learn(docs: DataFrame, learnable: Column, sample: int = SAMPLE, rows: int = ROWS) -> Model:
    """docs: doc_id, lang, text. Counts words of the sampled learnable rows in
    Spark; what comes to the driver is the words of at most about rows rows."""
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    each = min(sample, rows // max(1, len(sizes)))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000)) / 1e6
    limits = docs.sparkSession.createDataFrame([(r["lang"], each / r["n"]) for r in sizes], "lang string, share double")
    picked = known.join(F.broadcast(limits), "lang").where(share < F.col("share"))
    words = picked.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}[\\p{L}\\p{M}]*', 0)")).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).toArrow()
    langs, words_, ns = (counts[c].to_pylist() for c in ("lang", "word", "n"))
    return fit(sorted(zip(langs, words_, ns, strict=True)))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = sent.value.predict_all(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "lang_pred string", "score double"])
    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text_")).mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = learn(docs, ~held_out(F.col("doc_id"), 3, 1))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
