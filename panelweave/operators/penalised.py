"""Ridge, lasso and elastic net per group, all settings from one pass of moments.

Each group (a block of windows, say) is fitted on its own training rows only. The aggregate pass gives a group's means and
centred cross moments; a small solve per group and setting works on that matrix, so no row is read again however many
settings are tried. The objective is half the mean squared error plus ``reg * (elastic * |b|_1 + (1 - elastic) / 2 * |b|^2)``
over the slopes of the scaled regressors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.leastsq import group_moments, joined_moments, predict, unpack, without
from panelweave.spec import q

SCALERS = ("none", "standard", "robust")


@dataclass(frozen=True)
class Setting:
    reg: float
    elastic: float = 0.0
    scaler: str = "standard"
    keep: int | None = None  # regressors left by recursive elimination; None: all


def settings_grid(regs: Sequence[float], elastics: Sequence[float], scalers: Sequence[str] = ("standard",), keeps: Sequence[int | None] = (None,)) -> list[Setting]:
    if set(scalers) - set(SCALERS):
        raise ValueError(f"scalers must be among {SCALERS}")
    return [Setting(r, e, s, k) for s, k, r, e in product(scalers, keeps, regs, elastics)]


def eliminate(cross: np.ndarray, keep: int) -> list[int]:
    """Regressors that recursive elimination leaves: refit, drop the smallest standardised slope, repeat. y is the last variable."""
    k = len(cross) - 1
    left = [i for i in range(k) if cross[i, i] > 0]
    while len(left) > keep:
        sub = cross[np.ix_(left, left)]
        b = np.linalg.pinv(sub, rcond=1e-12, hermitian=True) @ cross[left, k]
        left.pop(int(np.argmin(np.abs(b) * np.sqrt(np.diag(sub)))))
    return left


def solve_penalised(gram: np.ndarray, corr: np.ndarray, reg: float, elastic: float, steps: int = 2000) -> np.ndarray:
    """Slopes that minimise the objective for a Gram matrix and correlations with y, both divided by n."""
    ridge = reg * (1 - elastic)
    if reg == 0 or elastic == 0:
        return np.linalg.pinv(gram + ridge * np.eye(len(gram)), rcond=1e-12, hermitian=True) @ corr
    b = np.zeros(len(gram))
    for _ in range(steps):
        before = b.copy()
        for j in range(len(gram)):
            if gram[j, j] <= 0:
                continue
            r = corr[j] - gram[j] @ b + gram[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - reg * elastic, 0.0) / (gram[j, j] + ridge)
        if np.abs(b - before).max() < 1e-12:
            break
    return b


def penalised_fits(train: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], settings: Sequence[Setting]) -> DataFrame:
    """(keys, setting, scaler, n_features, reg, elastic, n, coef): a row per group and setting.

    ``coef`` = [intercept, slopes in the order of ``xs``] on the original scale; eliminated regressors have slope 0. Groups
    without a complete row drop out, a constant regressor has slope 0. Robust widths are quartile ranges by the
    mergeable quantile sketch of Spark (accuracy 10,000).
    """
    m = group_moments(train, keys, y, xs).filter(F.col("n") > 0)
    if any(s.scaler == "robust" for s in settings):
        width = [(F.percentile_approx(q(x).cast("double"), 0.75, 10_000) - F.percentile_approx(q(x).cast("double"), 0.25, 10_000)) for x in xs]
        m = m.join(train.groupBy(*keys).agg(F.array(*width).alias("width")), list(keys)) if keys else m.withColumn("width", train.agg(F.array(*width)).scalar())
    else:
        m = m.withColumn("width", F.lit(None).cast("array<double>"))
    k = len(xs)
    tried = list(settings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                n, mean, s = row.n, np.asarray(row.mean, dtype=float), unpack(np.asarray(row.cross, dtype=float), k + 1)
                std = np.sqrt(np.maximum(np.diag(s)[:k], 0) / n)
                robust = np.ones(k) if row.width is None else np.array([w if w is not None and w > 0 else 1.0 for w in row.width], dtype=float)
                scales = {"none": np.ones(k), "standard": np.where(std > 0, std, 1.0), "robust": robust}
                for number, t in enumerate(tried):
                    left = eliminate(s, k if t.keep is None else t.keep)
                    scale = scales[t.scaler][left]
                    gram = s[np.ix_(left, left)] / n / np.outer(scale, scale)
                    slopes = np.zeros(k)
                    slopes[left] = solve_penalised(gram, s[left, k] / n / scale, t.reg, t.elastic) / scale
                    keyed = [getattr(row, c) for c in keys]
                    out.append((*keyed, number, t.scaler, k if t.keep is None else t.keep, t.reg, t.elastic, n, [float(mean[k] - slopes @ mean[:k]), *map(float, slopes)]))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    fields = [("setting", T.IntegerType()), ("scaler", T.StringType()), ("n_features", T.IntegerType()), ("reg", T.DoubleType()), ("elastic", T.DoubleType()), ("n", T.LongType()), ("coef", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*[train.schema[c] for c in keys], *[T.StructField(n, t) for n, t in fields]])
    return m.select(*keys, "n", "mean", "cross", "width").mapInPandas(run, schema)


def search_by_group(samples: DataFrame, keys: Sequence[str], split: str, y: str, xs: Sequence[str], settings: Sequence[Setting]) -> tuple[DataFrame, DataFrame]:
    """(trials, errors): every setting is fitted on the train rows of a group and judged by its val rows alone.

    ``trials``: (keys, setting, scaler, n_features, reg, elastic, val_mae, is_best), best by val error, then by number.
    ``errors``: (keys, split, n, mae) of each group's best setting on its train, val and test rows.
    """
    keys = list(keys)
    fits = penalised_fits(samples.filter(q(split) == "train"), keys, y, xs, settings)
    packed = fits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("setting", "coef"))).alias("fits"))
    error = lambda coef: F.abs(predict(coef, xs) - q(y))
    val = samples.filter(q(split) == "val").join(packed, keys).select(*keys, F.explode(F.transform("fits", lambda f: F.struct(f["setting"].alias("setting"), error(f["coef"]).alias("e")))).alias("t"))
    loss = val.groupBy(*keys, F.col("t.setting").alias("setting")).agg(F.avg("t.e").alias("val_mae"))
    best = loss.groupBy(*keys).agg(F.min(F.struct("val_mae", "setting")).alias("b")).select(*keys, F.col("b.setting").alias("best"))
    trials = fits.join(loss, [*keys, "setting"]).join(best, keys).select(*keys, "setting", "scaler", "n_features", "reg", "elastic", "val_mae", (F.col("setting") == F.col("best")).alias("is_best"))
    chosen = fits.join(best, keys).filter(F.col("setting") == F.col("best")).select(*keys, "coef")
    errors = samples.join(chosen, keys).groupBy(*keys, split).agg(F.count(F.lit(1)).alias("n"), F.avg(error(F.col("coef"))).alias("mae"))
    return trials, errors


def kept_features(train: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], keep: int) -> DataFrame:
    """(keys, features): the names that recursive elimination leaves in each group, from one pass of moments."""
    k, names = len(xs), list(xs)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def left(cross: pd.Series) -> pd.Series:
        return pd.Series([[names[i] for i in eliminate(unpack(np.asarray(c, dtype=float), k + 1), keep)] for c in cross])

    return group_moments(train, keys, y, xs).filter(F.col("n") > 0).select(*keys, left("cross").alias("features"))


def elimination_folds(train: DataFrame, keys: Sequence[str], fold: Column, y: str, xs: Sequence[str]) -> DataFrame:
    """(keys, n_features, cv_mse, features, is_best): recursive elimination judged by left-out folds, for every feature count.

    Rows are read once, into moments by group and fold. The moments without a fold are the group's minus the fold's; features are
    eliminated and fitted on them, and the fold's own moments give the squared error there. ``features`` are those that the whole
    group keeps at that count. The least error is best, then the fewest features. A null fold is one; groups without a complete row
    drop out; a fold whose removal leaves no row is not judged, and a group with no judged fold has a null error.
    """
    k, names, keys = len(xs), list(xs), list(keys)
    m = group_moments(train.withColumn("__fold", fold), [*keys, "__fold"], y, xs).filter(F.col("n") > 0)
    held = m.groupBy(*keys).agg(F.collect_list(F.struct("n", "mean", "cross")).alias("folds"))

    def squares(part: tuple, slopes: np.ndarray, intercept: float) -> float:
        n, mean, s = part
        return float(s[k, k] - 2 * slopes @ s[:k, k] + slopes @ s[:k, :k] @ slopes + n * (mean[k] - intercept - slopes @ mean[:k]) ** 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                parts = [(int(f["n"]), np.asarray(f["mean"], dtype=float), unpack(np.asarray(f["cross"], dtype=float), k + 1)) for f in row.folds]
                total = joined_moments(parts)
                left = [(part, without(total, part)) for part in parts if total[0] > part[0]]
                n = sum(part[0] for part, _ in left)
                error = {}
                for count in range(1, k + 1):
                    sse = 0.0
                    for part, rest in left:
                        keep = eliminate(rest[2], count)
                        slopes = np.zeros(k)
                        slopes[keep] = np.linalg.pinv(rest[2][np.ix_(keep, keep)], rcond=1e-12, hermitian=True) @ rest[2][keep, k]
                        sse += squares(part, slopes, rest[1][k] - slopes @ rest[1][:k])
                    error[count] = sse / n if n else None
                best = min(error, key=lambda c: (error[c], c)) if n else None
                out += [(*[getattr(row, c) for c in keys], c, e, [names[i] for i in eliminate(total[2], c)], c == best) for c, e in error.items()]
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    fields = [("n_features", T.IntegerType()), ("cv_mse", T.DoubleType()), ("features", T.ArrayType(T.StringType())), ("is_best", T.BooleanType())]
    schema = T.StructType([*[train.schema[c] for c in keys], *[T.StructField(c, t) for c, t in fields]])
    return held.mapInPandas(run, schema)


#: Shape and rate of the gamma priors of both precisions: next to no information.
PRIOR = 1e-6


def evidence(n: int, mean: np.ndarray, cross: np.ndarray, steps: int = 300, tol: float = 1e-10) -> tuple[np.ndarray, float, float, float, int]:
    """(slopes, noise precision, weight precision, effective number of weights, steps) that maximise the evidence of a linear model.

    Works on the eigenvalues of the regressors' centred squares: each step takes the posterior mean of the weights for the two
    precisions, then the precisions that fit it, until the weights stand still.
    """
    k = len(cross) - 1
    values, vectors = np.linalg.eigh(cross[:k, :k])
    values = np.maximum(values, 0.0)
    along = vectors.T @ cross[:k, k]
    spread = cross[k, k] / n
    noise, weight = 1.0 / spread if spread > 0 else 1.0, 1.0
    slopes, effective, step = np.zeros(k), 0.0, 0
    for step in range(1, steps + 1):
        turned = along / np.maximum(values + weight / noise, 1e-300)
        new = vectors @ turned
        sse = max(float(cross[k, k] - 2 * turned @ along + (values * turned) @ turned), 0.0)
        effective = float(np.sum(noise * values / (weight + noise * values)))
        weight = (effective + 2 * PRIOR) / (float(new @ new) + 2 * PRIOR)
        noise = (n - effective + 2 * PRIOR) / (sse + 2 * PRIOR)
        done = np.abs(new - slopes).sum() <= tol * max(np.abs(new).sum(), 1e-300)
        slopes = new
        if done:
            break
    return slopes, noise, weight, effective, step


def evidence_fits(train: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """(keys, n, noise_precision, weight_precision, effective, coef): Bayesian ridge of each group, from one pass of moments.

    ``coef`` = [intercept, slopes in the order of ``xs``]; the intercept is not shrunk. Groups without a complete row drop out.
    """
    k, keys = len(xs), list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                mean = np.asarray(row.mean, dtype=float)
                slopes, noise, weight, effective, _ = evidence(row.n, mean, unpack(np.asarray(row.cross, dtype=float), k + 1))
                out.append((*[getattr(row, c) for c in keys], row.n, noise, weight, effective, [float(mean[k] - slopes @ mean[:k]), *map(float, slopes)]))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    fields = [("n", T.LongType()), ("noise_precision", T.DoubleType()), ("weight_precision", T.DoubleType()), ("effective", T.DoubleType()), ("coef", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*[train.schema[c] for c in keys], *[T.StructField(c, t) for c, t in fields]])
    return group_moments(train, keys, y, xs).filter(F.col("n") > 0).select(*keys, "n", "mean", "cross").mapInPandas(run, schema)
