"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Each rule rejects a document whose feature is above a cutoff. CHAIN lists moves,
each of which tightens one rule, from what is safest to what is riskiest. After
each move, all rules so far make one verdict; a labelled holdout of good documents
tells for each stratum (language) how many of n it would reject: k. Moves are
tested in their fixed order by the exact binomial test of "the verdict's false
rejection rate is over alpha" at level delta / (strata + 1), the Bonferroni
correction over strata; the first move that doesn't pass ends the chain, so that
the moves themselves need no correction (fixed-sequence testing). So, with
probability 1 - delta, no stratum loses more than alpha of its good documents to
the rules. At the defaults and four strata, 228 good documents that pass the base
rule are enough if none of them is rejected.

Strata with too few labels for any move are pooled and tested as one; there the
guarantee is for the pool. Where even the pool has too few, and in strata without
any label, only the base rule holds.

Defined results: null or empty text has no words and fails the base rule; null
strata are one stratum; a document counts once, however often it is labelled (as
good, if any label says so) or repeated (then by its worst row); columns that clash
with the features' names are kept apart, since features live in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundwise.llm.common import free_name, staged, table, words

#: Moves from safe to risky: (rule, cutoff).
CHAIN: tuple[tuple[str, float], ...] = (
    *[("symbol_share", c) for c in (0.3, 0.2, 0.12, 0.08, 0.05)],
    ("repeat_share", 0.45), ("dup_line_share", 0.6), ("word_length", 14.0), ("capital_share", 0.8),
    ("symbol_share", 0.03), ("symbol_share", 0.02),
    ("repeat_share", 0.4), ("dup_line_share", 0.5), ("word_length", 11.0), ("capital_share", 0.6),
    ("repeat_share", 0.3), ("dup_line_share", 0.4), ("word_length", 9.0), ("capital_share", 0.4),
    ("repeat_share", 0.2), ("dup_line_share", 0.3), ("word_length", 8.0), ("capital_share", 0.3),
    ("repeat_share", 0.15), ("dup_line_share", 0.2), ("word_length", 7.0), ("capital_share", 0.2),
)


#: Strata whose depths are broadcast; more are joined by shuffle.
FEW = 10_000
#: Labelled ids that are broadcast: 8 bytes each.
LABELS = 2_000_000


@dataclass(frozen=True)
class Risk:
    alpha: float = 0.02
    delta: float = 0.05


def with_features(docs: DataFrame, text: str = "text", into: str = "_quality") -> DataFrame:
    """docs and a struct column of counts and shares; one narrow pass.

    Steps hold what later ones use more than once in plain columns, so that the
    optimizer keeps them apart and computes each once."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != into]
    mark = "_q"
    while any(c.startswith(mark) for c in docs.columns if c != into):
        mark += "_"
    at = lambda name: F.col(f"`{mark}{name}`")
    put = lambda **new: [c.alias(f"{mark}{n}") for n, c in new.items()]
    held = lambda *names: [at(n) for n in names]

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.select(*own, *put(
        words=words(t),
        lines=F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        n_symbols=(F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
        n_capitals=(F.length(t) - F.length(F.regexp_replace(t, r"[A-Z]+", ""))).cast("long"),
    ))
    w = at("words")
    hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    counts = ("n_symbols", "n_capitals")
    out = out.select(*own, w, *held(*counts), *put(
        n_words=F.size(w).cast("long"),
        word_chars=F.length(F.array_join(w, "")).cast("long"),
        n_lines=F.size(at("lines")).cast("long"),
        n_dup_lines=(F.size(at("lines")) - F.size(F.array_distinct(at("lines")))).cast("long"),
        hashes=F.when(F.size(w) >= 4, F.transform(F.sequence(F.lit(0), F.size(w) - 3), hashed)),
    ))
    counts = ("n_words", "word_chars", *counts, "n_lines", "n_dup_lines")
    # Only where hashes repeat are windows sorted, first by hash, then by words:
    # a window is repeated if it equals the one before or after it.
    near = lambda s, field: F.filter(
        F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (x[field].eqNullSafe(F.get(s, j - 1)[field]) | x[field].eqNullSafe(F.get(s, j + 1)[field])).alias("r"))), lambda x: x["r"])
    h = at("hashes")
    pairs = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    out = out.select(*own, *held(*counts), w, *put(pairs=pairs))
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    same = F.transform(near(at("pairs"), "h"), lambda x: F.struct(window(x["i"]).alias("w"), x["i"].alias("i")))
    out = out.select(*own, *held(*counts), *put(sorted=F.sort_array(same)))
    out = out.select(*own, *held(*counts), *put(at=F.sort_array(F.transform(near(at("sorted"), "w"), lambda x: x["i"]))))
    covered = F.aggregate(
        at("at"),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    out = out.select(*own, *held(*counts), *put(n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long")))
    share = lambda a, b: F.coalesce(at(a) / F.nullif(at(b), F.lit(0)), F.lit(0.0))
    return out.select(*own, F.struct(
        *[at(k).alias(k) for k in (*counts, "n_repeat_words")],
        ((at("n_words") < 50) | (100 * at("n_repeat_words") > 50 * at("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("word_length"),
    ).alias(into))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exactly summed; 1 where k >= n * p."""
    odds = F.lit(p / (1 - p))
    start = n * F.log1p(F.lit(-p))
    summed = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(start.alias("term"), F.exp(start).alias("sum")),
        lambda a, i: F.struct((a["term"] + F.log(odds * (n - i + 1) / i)).alias("term"), (a["sum"] + F.exp(a["term"] + F.log(odds * (n - i + 1) / i))).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(summed)


def step(feature) -> Column:
    """feature: name to Column. The first move of the chain that rejects; null: none."""
    return F.array_min(F.array(*[F.when(feature(r) > c, F.lit(i)) for i, (r, c) in enumerate(CHAIN)]))


def depths(measured: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "stratum", key: str = "doc_id") -> DataFrame:
    """stratum and depth, how many moves of the chain hold there.

    measured: key, stratum, base_failed and step, of a written table. labels: key and
    quality (1: good)."""
    good = measured.join(labels.where("quality = 1").select(key).distinct(), key)
    good = good.where(~F.col("base_failed")).groupBy(stratum, key).agg(F.min("step").alias("step"))
    tries = range(len(CHAIN))
    counts = good.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("step") <= i).alias(f"k{i}") for i in tries])
    counts = staged(counts, "strata")
    level = counts.agg((F.lit(risk.delta) / (F.count(F.lit(1)) + 1)).alias("level"))
    seen = counts.crossJoin(F.broadcast(level)).withColumn("pool", F.when(F.pow(F.lit(1 - risk.alpha), F.col("n")) <= F.col("level"), F.col(stratum)))
    pools = seen.groupBy("pool", "level").agg(F.sum("n").alias("n"), *[F.sum(f"k{i}").alias(f"k{i}") for i in tries])
    passed = F.array(*[binomial_tail(F.col("n"), F.col(f"k{i}"), risk.alpha) <= F.col("level") for i in tries])
    first = F.array_position(passed, False)
    pools = pools.select(F.col("pool").alias("pool_"), F.when(first == 0, len(CHAIN)).otherwise(first - 1).cast("int").alias("depth"))
    return seen.join(pools, F.col("pool").eqNullSafe(F.col("pool_"))).select(stratum, "depth")


def with_depth(df: DataFrame, depth: DataFrame, stratum: str) -> DataFrame:
    """df with the depth of its stratum; broadcast if there are few strata."""
    depth = staged(depth, "depths")
    return df.join(F.broadcast(depth) if depth.count() <= FEW else depth, stratum, "left")


def verdict(base_failed: Column, step_: Column, depth: Column) -> Column:
    """Whether a document stays, in one term, so no part is pushed into the features."""
    return F.when(F.coalesce(step_ < depth, F.lit(False)), F.lit(False)).otherwise(~base_failed)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row a document: doc_id, counts, shares, base_failed, step, depth, kept."""
    measured = with_features(docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), "text"))
    measured = staged(measured.select("doc_id", "stratum", "_quality.*").withColumn("step", step(F.col)), "quality")
    return with_depth(measured, depths(measured, labels, risk), "stratum").withColumn("kept", verdict(F.col("base_failed"), F.col("step"), F.col("depth")))


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of docs that pass, with the columns of docs. Cutoffs need the
    features of labelled good documents only, the verdict those of all."""
    stratum = F.coalesce(F.col("lang"), F.lit(""))
    good = staged(labels.where("quality = 1").select("doc_id").distinct(), "labelled")
    holdout = docs.select("doc_id", stratum.alias("stratum"), "text")
    if good.count() <= LABELS:  # beyond, features of all are cheaper than to shuffle texts
        holdout = holdout.join(F.broadcast(good), "doc_id", "left_semi")
    holdout = with_features(holdout)
    # written first: a filter on it would be pushed into the features and compute them many times
    measured = staged(holdout.select("doc_id", "stratum", "_quality.base_failed", step(lambda r: F.col("_quality")[r]).alias("step")), "holdout")
    mark = free_name("_stratum", docs)
    into = free_name("_quality", docs)
    seen = with_features(docs.withColumn(mark, stratum), into=into)
    chosen = depths(measured, labels, risk).select(F.col("stratum").alias(mark), F.col("depth").alias(f"{mark}depth"))
    q = F.col(f"`{into}`")
    stays = with_depth(seen, chosen, mark).where(verdict(q["base_failed"], step(lambda r: q[r]), F.col(f"{mark}depth")))
    return stays.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STEP = "list_min([" + ", ".join(f"CASE WHEN v.{r} > {c} THEN {i} END" for i, (r, c) in enumerate(CHAIN)) + "])"
_ALPHA, _DELTA = Risk().alpha, Risk().delta
#: The rows of op1_quality_rules in DuckDB's SQL.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
s AS (SELECT rid, doc_id, stratum, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM d),
wi AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 3)),
re AS (SELECT rid, win FROM wi GROUP BY ALL HAVING count(*) > 1),
cv AS (SELECT rid, count(DISTINCT i + j) AS n FROM wi JOIN re USING (rid, win), (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
c AS (SELECT s.rid, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')))::BIGINT AS n_capitals,
  len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cv.n, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN cv USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {{
  'symbol_share': coalesce(n_symbols / nullif(word_chars, 0)::DOUBLE, 0), 'capital_share': coalesce(n_capitals / nullif(word_chars, 0)::DOUBLE, 0),
  'dup_line_share': coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0), 'repeat_share': coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0),
  'word_length': coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0)}} AS v FROM c),
m AS (SELECT *, {_STEP} AS step FROM f),
good AS (SELECT stratum, doc_id, min(step) AS step FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
n AS (SELECT stratum, count(*) AS n, (SELECT {_DELTA} / (count(DISTINCT stratum) + 1) FROM good) AS level FROM good GROUP BY stratum),
p AS (SELECT stratum, CASE WHEN pow(1 - {_ALPHA}, n) <= level THEN stratum END AS pool, level FROM n),
k AS (SELECT pool, level, i, count(*) AS n, count(*) FILTER (WHERE step <= i) AS k FROM good JOIN p USING (stratum), (SELECT unnest(range({len(CHAIN)})) AS i) GROUP BY ALL),
b AS (SELECT *, CASE WHEN k >= n * {_ALPHA} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_ALPHA}) + (n - i) * ln(1 - {_ALPHA})))) END AS bound FROM k),
deep AS (SELECT pool, coalesce(min(i) FILTER (WHERE bound > level), {len(CHAIN)}) AS depth FROM b GROUP BY pool),
cut AS (SELECT stratum, depth FROM p JOIN deep ON p.pool IS NOT DISTINCT FROM deep.pool)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(step < depth, false) AS kept FROM m LEFT JOIN cut USING (stratum)
"""
