"""K-means with deterministic seeds. A pass sends Arrow batches to numpy, which gives
back a few rows of sums a batch for all models that are fitted at once; Spark adds
them up, so what meets on the driver is one row a centre."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decimals that centres are rounded to, so that the order of sums doesn't matter.
DECIMALS = 9


def _points(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, batch.num_columns)])


def _near(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point (of ties the lowest), and its squared distance."""
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def seeds(df: DataFrame, names: list[str], k: int) -> np.ndarray:
    """df: idx and names. The row at 31 % and then, again and again, the one
    farthest from all chosen (of ties, the first). Fewer if fewer rows differ."""
    n = df.count()
    first = df.where(F.col("idx") == min(n - 1, int(n * 0.31))).select(*names).first() if n else None
    found = np.array([list(first)]) if first else np.zeros((0, len(names)))
    while first and len(found) < k:
        held = found

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, idx = _points(batch, 1), batch.column(0).to_numpy()
                    far = _near(x, held)[1]
                    best = np.lexsort((idx, -far))[0]
                    yield pa.RecordBatch.from_arrays([pa.array([far[best]]), pa.array([idx[best]]), pa.array([x[best].tolist()])], names=["far", "idx", "v"])

        best = df.select("idx", *names).mapInArrow(run, "far double, idx long, v array<double>").orderBy(F.desc("far"), "idx").first()
        if best.far == 0:
            break
        found = np.vstack([found, best.v])
    return found


def totals(df: DataFrame, names: list[str], models: dict[int, np.ndarray]) -> dict[int, list]:
    """For each model (by its key, its centres) the rows (cluster, n, squared
    distances, means), by one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, out = _points(batch, 0), []
            for key, centres in models.items():
                at, far = _near(x, centres)
                for c in np.unique(at).tolist():
                    out.append((key, c, int((at == c).sum()), float(far[at == c].sum()), *x[at == c].sum(axis=0).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(v)) for v in zip(*out, strict=True)], names=["model", "cluster", "n", "far", *names])

    schema = ", ".join(["model long, cluster long, n long, far double", *[f"`{n}` double" for n in names]])
    sums = df.select(*names).mapInArrow(run, schema).groupBy("model", "cluster")
    rows = sums.agg(F.sum("n").alias("n"), F.sum("far").alias("far"), *[F.sum(n).alias(n) for n in names]).collect()
    out: dict[int, list] = {key: [] for key in models}
    for r in sorted(rows, key=lambda r: (r.model, r.cluster)):
        out[r.model].append((r.cluster, r.n, r.far, [round(r[n] / r.n, DECIMALS) for n in names]))
    return out


def fit(df: DataFrame, names: list[str], models: dict[int, np.ndarray], rounds: int = 12) -> dict[int, np.ndarray]:
    """The models' centres after Lloyd steps; a centre without rows stays."""
    moving = {k: c for k, c in models.items() if len(c)}
    done = dict(models)
    for _ in range(rounds if moving else 0):
        for key, rows in totals(df, names, moving).items():
            new = moving[key].copy()
            for cluster, _, _, means in rows:
                new[cluster] = means
            if (new == moving[key]).all():
                del moving[key]
            else:
                moving[key] = new
            done[key] = new
        if not moving:
            break
    return done


def bic(df: DataFrame, names: list[str], models: dict[int, np.ndarray]) -> dict[int, float]:
    """n ln(mse) + k d ln(n) of each model, to choose k by."""
    out = {}
    for key, rows in totals(df, names, {k: c for k, c in models.items() if len(c)}).items():
        n, sse = sum(r[1] for r in rows), sum(r[2] for r in rows)
        out[key] = n * math.log(max(1e-9, sse / max(1, n))) + len(models[key]) * len(names) * math.log(max(1, n)) if n else 0.0
    return out


def chosen(df: DataFrame, names: list[str], ks: range, trial: int = 8, rounds: int = 12) -> np.ndarray:
    """Centres of the number whose short fit has the least bic (of ties the least
    number). All numbers share their seeds and are fitted by the same passes."""
    every = seeds(df, names, max(ks))
    if not len(every):
        return every
    models = {k: every[:k] for k in ks if k <= len(every)} or {len(every): every}
    scores = bic(df, names, fit(df, names, models, trial))
    best = min(scores, key=lambda k: (scores[k], k))
    return fit(df, names, {best: models[best]}, rounds)[best]


def assigned(df: DataFrame, names: list[str], centres: np.ndarray) -> DataFrame:
    """df with cluster, the nearest centre (of ties the lowest)."""
    distance = lambda c: sum(((F.col(n) - v) * (F.col(n) - v) for n, v in zip(names, c.tolist(), strict=True)), F.lit(0.0))
    each = df.select("*", *[distance(c).alias(f"_d{i}") for i, c in enumerate(centres)])
    near = F.least(*[F.col(f"_d{i}") for i in range(len(centres))]) if len(centres) > 1 else F.col("_d0")
    return each.select(*df.columns, F.coalesce(*[F.when(F.col(f"_d{i}") == near, F.lit(i)) for i in range(len(centres))]).alias("cluster"))
