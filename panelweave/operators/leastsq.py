"""Least squares per group from aggregated moments.

One aggregate pass gives means and centred cross moments (all mergeable, so hot groups combine map-side); a
small vectorised solve turns each group's moment matrix into coefficients. No group is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lgamma, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.spec import q


def moments(y: str, xs: Sequence[str]) -> list[Column]:
    """Aggregates over complete rows: ``n``, ``mean`` = array over (xs, y), ``cross`` = upper triangle, centred sums."""
    names = [*xs, y]
    complete = F.lit(True)
    for c in names:
        complete = complete & q(c).isNotNull()
    v = [F.when(complete, q(c).cast("double")) for c in names]
    n = F.count_if(complete)
    cross = [F.covar_pop(v[i], v[j]) * n for i in range(len(v)) for j in range(i, len(v))]
    return [n.alias("n"), F.array(*[F.avg(c) for c in v]).alias("mean"), F.array(*cross).alias("cross")]


#: Up to so many variables moments are plain aggregates; their number grows with the square, beyond what plans carry.
PLAIN_VARIABLES = 16


def group_moments(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """(keys, n, mean, cross) of complete rows. Frames of many variables sum a matrix per task instead of an expression per pair."""
    if len(xs) + 1 > PLAIN_VARIABLES:
        return _gram_moments(df, list(keys), [*xs, y])
    return df.groupBy(*keys).agg(*moments(y, xs)) if keys else df.agg(*moments(y, xs))


def joined_moments(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and centred squares of several parts as those of the whole."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def _gram_moments(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Moments by matrix products: one matrix per task and group, joined in two steps, so no group gathers a row per task."""
    integral = [isinstance(df.schema[c].dataType, T.IntegralType) for c in keys]
    k, upper = len(names), np.triu_indices(len(names))
    schema = T.StructType([*[df.schema[c] for c in keys], T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("cross", T.ArrayType(T.DoubleType()))])

    columns = [f.name for f in schema]

    def rows(held: dict) -> pd.DataFrame:
        # A missing key comes as NaN; whole numbers come as floats beside it.
        plain = lambda key: [None if pd.isna(x) else int(x) if whole else x for x, whole in zip(key, integral, strict=True)]
        out = [(*plain(key), part, n, mean.tolist(), cross[upper].tolist()) for (key, part), (n, mean, cross) in held.items()]
        return pd.DataFrame(out, columns=columns).astype(dict.fromkeys(keys, object))

    def per_task(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() % 64, {}
        for frame in batches:
            for key, own in frame.dropna(subset=names).groupby(keys, dropna=False) if keys else [((), frame.dropna(subset=names))]:
                x = own[names].to_numpy(dtype=float)
                if len(x):
                    d = x - x.mean(0)
                    new = (len(x), x.mean(0), d.T @ d)
                    held[key, part] = joined_moments([held[key, part], new]) if (key, part) in held else new
        yield rows(held)

    def joined(final: bool):
        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            whole = joined_moments([(n, np.asarray(m), unpack(np.asarray(c), k)) for n, m, c in zip(frame["n"], frame["mean"], frame["cross"], strict=True)])
            return rows({(tuple(key[: len(keys)]), 0 if final else key[-1]): whole})

        return run

    small = df.select(*[q(c) for c in keys], *[q(c).cast("double").alias(c) for c in names]).mapInPandas(per_task, schema)
    small = small.groupBy(*keys, "part").applyInPandas(joined(False), schema)
    last = small.groupBy(*keys) if keys else small.withColumn("part", F.lit(0)).groupBy("part")
    return last.applyInPandas(joined(True), schema).drop("part")


def without(total: tuple[int, np.ndarray, np.ndarray], part: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """The count, mean and centred squares that are left when a part's rows are taken out of the whole."""
    n = total[0] - part[0]
    if n <= 0:
        return 0, np.zeros_like(total[1]), np.zeros_like(total[2])
    mean = total[1] + part[0] * (total[1] - part[1]) / n
    return n, mean, total[2] - part[2] - (n * part[0] / total[0]) * np.outer(mean - part[1], mean - part[1])


def merge_moments(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Combine moment rows (``n``, ``mean``, ``cross`` over ``k`` variables) into one row per key.

    Means are first taken relative to ``ref`` (any per-key constant array near the data, such as the plain
    average of the means), so the merge keeps its precision.
    """
    n = F.col("n")
    ref = df.groupBy(*keys).agg(*[F.avg(F.when(n > 0, F.col("mean")[i])).alias(f"__r{i}") for i in range(k)])
    d = [F.coalesce(F.col("mean")[i] - F.col(f"__r{i}"), F.lit(0.0)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    joined = df.join(ref, list(keys))
    agg = joined.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.first(f"__r{i}").alias(f"__r{i}") for i in range(k)],
        *[F.sum(n * d[i]).alias(f"__s{i}") for i in range(k)],
        *[F.sum(F.coalesce(F.col("cross")[p], F.lit(0.0)) + n * d[i] * d[j]).alias(f"__c{p}") for p, (i, j) in enumerate(pairs)],
    )
    mean = [F.col(f"__r{i}") + F.try_divide(F.col(f"__s{i}"), n) for i in range(k)]
    cross = [
        F.col(f"__c{p}") - F.try_divide(F.col(f"__s{i}") * F.col(f"__s{j}"), n) for p, (i, j) in enumerate(pairs)
    ]
    return agg.select(*keys, "n", F.array(*mean).alias("mean"), F.array(*cross).alias("cross"))


def unpack(cross: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = cross
    return m + np.triu(m, 1).T


def _finite(values: object) -> bool:
    return values is not None and np.isfinite(np.asarray(values, dtype=float)).all()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_coefficients(mean: pd.Series, cross: pd.Series) -> pd.Series:
    """[intercept, slopes...] of the last variable on the others; minimum-norm when the fit is not unique."""
    out = []
    for m, c in zip(mean, cross):
        if not _finite(m) or not _finite(c):
            out.append(None)
            continue
        m = np.asarray(m, dtype=float)
        s = unpack(np.asarray(c, dtype=float), len(m))
        slopes = np.linalg.pinv(s[:-1, :-1], rcond=1e-12, hermitian=True) @ s[:-1, -1]
        out.append([float(m[-1] - slopes @ m[:-1]), *[float(b) for b in slopes]])
    return pd.Series(out)


def fit_least_squares(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """(keys, n, coef) with ``coef`` = [intercept, slopes in the order of ``xs``]; groups without a complete row drop out."""
    m = group_moments(df, keys, y, xs).filter(F.col("n") > 0)
    if len(xs) == 1:
        return m.select(*keys, "n", single_regressor("mean", "cross").alias("coef"))
    return m.select(*keys, "n", solve_coefficients("mean", "cross").alias("coef"))


def single_regressor(mean: str, cross: str) -> Column:
    """Closed form for one regressor; a constant regressor gives slope 0."""
    sxx, sxy = F.col(cross)[0], F.col(cross)[1]
    slope = F.coalesce(F.try_divide(sxy, sxx), F.lit(0.0))
    return F.array(F.col(mean)[1] - slope * F.col(mean)[0], slope)


def predict(coef: Column, xs: Sequence[str]) -> Column:
    out = coef[0]
    for i, x in enumerate(xs):
        out = out + coef[i + 1] * q(x)
    return out


def coefficient_table(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """One row per group and term: coefficient, standard error, t value, two-sided p value, n.

    Standard errors are the square roots of the diagonal of MSE * inverse(X'X) with n - k - 1 degrees of freedom.
    """
    k = len(xs)
    names = ["(intercept)", *xs]
    m = group_moments(df, keys, y, xs).filter(F.col("n") > k + 1)
    stats = m.select(*keys, "n", F.explode(_term_stats("n", "mean", "cross")).alias("e"))
    return stats.select(
        *keys,
        F.element_at(F.array(*[F.lit(x) for x in names]), F.col("e.term") + 1).alias("term"),
        "e.coef",
        "e.std_error",
        "e.t_value",
        "e.p_value",
        "n",
    )


TERM_STATS = T.ArrayType(
    T.StructType(
        [T.StructField("term", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in ("coef", "std_error", "t_value", "p_value")]
    )
)


@F.pandas_udf(TERM_STATS)
def _term_stats(n: pd.Series, mean: pd.Series, cross: pd.Series) -> pd.Series:
    out = []
    for size, m, c in zip(n, mean, cross):
        m = np.asarray(m, dtype=float)
        s = unpack(np.asarray(c, dtype=float), len(m))
        k = len(m) - 1
        inv = np.linalg.pinv(s[:k, :k], rcond=1e-12, hermitian=True)
        b = inv @ s[:k, k]
        df = size - k - 1
        mse = max(s[k, k] - b @ s[:k, k], 0.0) / df
        se = np.sqrt(np.concatenate([[mse * (1.0 / size + m[:k] @ inv @ m[:k])], mse * np.diag(inv)]))
        coef = np.concatenate([[m[k] - b @ m[:k]], b])
        with np.errstate(divide="ignore", invalid="ignore"):
            t = coef / se
        out.append(
            [
                {"term": i, "coef": float(coef[i]), "std_error": float(se[i]), "t_value": float(t[i]), "p_value": student_p(float(t[i]), df)}
                for i in range(k + 1)
            ]
        )
    return pd.Series(out)


def student_p(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta I_{df/(df+t^2)}(df/2, 1/2).

    Evaluated by Gauss-Legendre quadrature after the substitution that removes the end-point singularity.
    """
    if not np.isfinite(t):
        return 0.0 if np.isinf(t) else float("nan")
    # P(|T| > t) = integral over theta from atan(t / sqrt(df)) to pi/2 of cos^(df-1), normalised.
    start = np.arctan(abs(t) / np.sqrt(df))
    nodes, weights = np.polynomial.legendre.leggauss(64)
    width = min(pi / 2 - start, 40.0 / np.sqrt(max(df, 1.0)))
    theta = start + (nodes + 1) * width / 2
    log_c = lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * np.log(pi)
    body = np.exp(log_c + (df - 1) * np.log(np.cos(theta)))
    return float(min(1.0, 2 * np.sum(weights * body) * width / 2))
