"""The oracle forecast: Spark counts, and one small fold a target decides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundwise.catalog import query
from roundwise.operators import ordered, outlooks
from roundwise.operators.outlooks import TARGETS
from roundwise.plans.fixtures import R, param
from roundwise.plans.sequences import I, by_target, sequence

# Rows of a stretch up to a target, stretches compared and kept.
LENGTHS, CANDIDATES, NEAREST = ((30, 12), (100, 10), (float("inf"), 8)), 5500, 24
NEWEST, TAIL = 150, 48


def length_of(target: int) -> int:
    return int(outlooks.upto(LENGTHS, target))


def hits_of(spark, sf_dir, targets=tuple(TARGETS)) -> DataFrame:
    """target, round_id, idx (of the hit) and gap (null for the first)."""
    h = ordered.indexed(by_target(spark, sf_dir, targets).where("hit").select("target", "round_id"), ("target",))
    h = ordered.framed(h, 1, 0, lambda rows: {"before": F.max("round_id").over(rows(-1, -1))}, ("target",))
    return h.withColumn("gap", F.col("round_id") - F.col("before")).drop("before")


def support(seq: DataFrame, targets=tuple(TARGETS)) -> DataFrame:
    """target, sample, random, matches, hits: of stretches taken at an even stride,
    how many were followed by the target within its window, and of the NEAREST ones
    by mean absolute difference of logs to the newest stretch. CANDIDATES bounds the
    stretches of a target at any length of history; the stride is the definition."""
    x = F.ln(F.greatest(F.lit(1.0001), F.col("multiplier")))
    longest = length_of(min(targets))
    shapes = {t: (length_of(t), TARGETS[t][0]) for t in targets}
    reach = max(n + w for n, w in shapes.values()) - 1
    top = lambda rows, t: F.max("multiplier").over(rows(shapes[t][0], sum(shapes[t]) - 1))
    made = ordered.framed(seq, 0, reach, lambda rows: {"v": F.collect_list(x).over(rows(0, longest - 1)), **{f"top{t}": top(rows, t) for t in targets}})
    whole = F.broadcast(seq.agg((F.max("idx") + 1).alias("n")))
    newest = seq.crossJoin(whole).where(F.col("idx") >= F.col("n") - longest).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", x.alias("x")))), lambda s: s["x"]).alias("c"), F.max("n").alias("n"))
    last = lambda t: F.col("n") - sum(shapes[t]) - 1
    ready = lambda t: F.col("n") >= sum(shapes[t]) + 30
    stride = lambda t: F.greatest(F.lit(1), F.ceil((last(t) + 1) / CANDIDATES))
    far = lambda n: F.aggregate(F.zip_with(F.slice("v", 1, n), F.slice("c", -n, n), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b) / n
    one = lambda t: F.when(ready(t) & (F.col("idx") <= last(t)) & (F.col("idx") % stride(t) == 0), F.struct(F.lit(t).alias("target"), far(shapes[t][0]).alias("distance"), F.coalesce(F.col(f"top{t}") >= t, F.lit(False)).alias("hit")))
    each = made.crossJoin(F.broadcast(newest)).select(F.col("idx").alias("start"), F.explode(F.array_compact(F.array(*[one(t) for t in targets]))).alias("s")).select("start", "s.*")
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("distance", "start")))
    near = F.col("place") <= NEAREST
    return placed.groupBy("target").agg(F.count(F.lit(1)).alias("sample"), F.count_if("hit").alias("random"), F.count_if(near).alias("matches"), F.count_if(near & F.col("hit")).alias("hits"))


def facts(spark, sf_dir, targets=tuple(TARGETS)) -> DataFrame:
    """One row a target with all that its outlook needs: distinct gaps with counts,
    the newest gaps and values, ids, hits and the support of similar stretches."""
    seq, h = sequence(spark, sf_dir), hits_of(spark, sf_dir, targets)
    tally = h.where("gap IS NOT NULL").groupBy("target", "gap").agg(F.count(F.lit(1)).alias("n")).groupBy("target").agg(F.collect_list(F.struct("gap", "n")).alias("tally"))
    ends = h.groupBy("target").agg(F.count(F.lit(1)).alias("hits"), F.max("round_id").alias("last_hit"))
    late = h.join(F.broadcast(ends.select("target", "hits")), "target").where((F.col("idx") >= F.col("hits") - NEWEST) & F.col("gap").isNotNull())
    late = late.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "gap"))), lambda s: s["gap"]).alias("recent"))
    n = F.broadcast(seq.agg((F.max("idx") + 1).alias("n"), F.max("round_id").alias("now")))
    tail = seq.crossJoin(n).where(F.col("idx") >= F.col("n") - TAIL).agg(F.max("now").alias("now"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "multiplier"))), lambda s: s["multiplier"]).alias("last"))
    out = param(spark, "target int", targets).crossJoin(tail)
    for part in (ends, tally, late, support(seq, targets).withColumnRenamed("hits", "near_hits")):
        out = out.join(part, "target", "left")
    return out


def decided(row) -> dict:
    """The outlook of a row of facts."""
    tally = sorted((int(x["gap"]), int(x["n"])) for x in (row["tally"] if row["tally"] is not None else []))
    gaps = outlooks.Gaps(*(np.array([x[i] for x in tally], np.int64) for i in (0, 1)))
    number = lambda x: 0 if pd.isna(x) else int(x)
    recent = np.array(row["recent"] if row["recent"] is not None else [], np.int64)
    near = {"sample": number(row["sample"]), "random": number(row["random"]), "matches": number(row["matches"]), "hits": number(row["near_hits"])}
    return outlooks.outlook(int(row["target"]), gaps, recent, np.array(row["last"], float), int(row["now"]), None if pd.isna(row["last_hit"]) else int(row["last_hit"]), number(row["hits"]), near)


@query()
def oracle_forecast(spark, sf_dir):
    """target, key, value, text: all fields of each target's forecast, flattened.
    Flags are 0 or 1, names are texts."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if row["last"] is None or not len(row["last"]):
                    continue
                for key, v in decided(row).items():
                    out.append((row["target"], key, None if v is None or isinstance(v, str) else float(v), v if isinstance(v, str) else None))
            yield pd.DataFrame(out, columns=["target", "key", "value", "text"])

    return facts(spark, sf_dir).mapInPandas(run, "target int, key string, value double, text string").withColumn("value", F.round("value", 6))


SUPPORT_TARGETS = (5, 10, 50, 1000)
_PARTS = " UNION ALL ".join(
    f"""SELECT {t} AS target, idx, hit{t} AS hit, d{t} AS distance FROM d, n WHERE n >= {length_of(t) + TARGETS[t][0] + 30} AND idx <= n - {length_of(t) + TARGETS[t][0] + 1}
    AND idx % greatest(1, CAST(ceil((n - {length_of(t) + TARGETS[t][0]}) / {CANDIDATES}.0) AS BIGINT)) = 0""" for t in SUPPORT_TARGETS)
_COLUMNS = ", ".join(
    f"""coalesce(max(multiplier) OVER (ORDER BY idx ROWS BETWEEN {length_of(t)} FOLLOWING AND {length_of(t) + TARGETS[t][0] - 1} FOLLOWING) >= {t}, false) AS hit{t},
    list_sum(list_transform(range(1, {length_of(t) + 1}), lambda j: abs(v[j] - c[len(c) - {length_of(t)} + j]))) / {length_of(t)} AS d{t}""" for t in SUPPORT_TARGETS)


@query(f"""WITH {I}, n AS (SELECT count(*) AS n FROM i), x AS (SELECT idx, multiplier, ln(greatest(1.0001, multiplier)) AS x FROM i),
cur AS (SELECT list(x ORDER BY idx) AS c FROM x, n WHERE idx >= n - 12),
w AS (SELECT idx, multiplier, list(x) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS v, c FROM x, cur),
d AS (SELECT idx, {_COLUMNS} FROM w), e AS ({_PARTS}),
p AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, idx) <= {NEAREST} AS near FROM e)
SELECT target, count(*) AS sample, count(*) FILTER (WHERE hit) AS random, count(*) FILTER (WHERE near) AS matches, count(*) FILTER (WHERE near AND hit) AS hits FROM p GROUP BY target""")
def pattern_support(spark, sf_dir):
    """Support of the stretches most like the newest, beside that of all."""
    return support(sequence(spark, sf_dir), SUPPORT_TARGETS)


@query(f"WITH {R}, l AS (SELECT multiplier, row_number() OVER (ORDER BY round_id DESC) AS back FROM rounds), h AS (SELECT *, multiplier <= 1.25 AS hard, multiplier <= 1.9 AS soft FROM l WHERE back <= 24) SELECT round(avg(hard::INT), 9) AS hard_rate, round(avg(soft::INT), 9) AS soft_rate, coalesce(min(back) FILTER (WHERE NOT hard), 25) - 1 AS hard_tail, coalesce(min(back) FILTER (WHERE NOT soft), 25) - 1 AS soft_tail, round(regr_slope(ln(greatest(1.0001, multiplier)), -back) * 23 / abs(avg(ln(greatest(1.0001, multiplier)))) * 100, 6) AS trend24 FROM h")
def pattern_measures(spark, sf_dir):
    """Measures of the newest 24 rows for target 5."""
    r = sequence(spark, sf_dir)
    n = F.broadcast(r.agg((F.max("idx") + 1).alias("n")))
    tail = r.crossJoin(n).where(F.col("idx") >= F.col("n") - 24).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "multiplier"))), lambda s: s["multiplier"]).alias("last"))

    def run(batches):
        for pdf in batches:
            rows = [outlooks.measures(5, np.array(x, float), np.zeros(0), 9, 1.0) for x in pdf["last"] if x is not None and len(x)]
            yield pd.DataFrame([(round(m["hard_rate"], 9), round(m["soft_rate"], 9), m["hard_tail"], m["soft_tail"], round(m["trend24"], 6)) for m in rows], columns=["hard_rate", "soft_rate", "hard_tail", "soft_tail", "trend24"])

    return tail.mapInPandas(run, "hard_rate double, soft_rate double, hard_tail long, soft_tail long, trend24 double")
