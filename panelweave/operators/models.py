"""Model-side jobs: every fit and score runs on Spark over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.metrics import error_table
from panelweave.operators.leastsq import fit_least_squares, group_moments, predict, solve_coefficients
from panelweave.operators.quantiles import exact_quantiles
from panelweave.session import staged
from panelweave.spec import q


def regression_summary(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per key: n, r2, adjusted r2 and F statistic of the least-squares fit, all from one pass of moments."""
    k = len(xs)
    m = group_moments(df, keys, y, xs).filter(F.col("n") > k + 1)
    fitted = m.withColumn("coef", solve_coefficients("mean", "cross"))
    size = k + 1

    def with_y(i: int) -> Column:
        """The cross moment of variable i (k = y itself) with y, from the upper triangle."""
        return F.col("cross")[i * size - i * (i - 1) // 2 + (k - i)]

    sst = with_y(k)
    explained = F.lit(0.0)
    for i in range(k):
        explained = explained + F.col("coef")[i + 1] * with_y(i)
    sse = sst - explained
    r2 = F.try_divide(explained, sst)
    return fitted.select(
        *keys,
        "n",
        r2.alias("r2"),
        (1 - (1 - r2) * F.try_divide(F.col("n") - 1, F.col("n") - k - 1)).alias("adj_r2"),
        F.try_divide(explained / k, F.try_divide(sse, F.col("n") - k - 1)).alias("f_stat"),
    )


def residual_quartiles(df: DataFrame, residual: str) -> dict[str, float | None]:
    got = exact_quantiles(df, {residual: [0.0, 0.25, 0.5, 0.75, 1.0]})[residual]
    return dict(zip(("min", "q1", "median", "q3", "max"), got))


def walk_forward(samples: DataFrame, block: str, split: str, y: str, fit_predict: Callable[[DataFrame, DataFrame], DataFrame], metrics: Sequence[str] = ("mae", "mse")) -> DataFrame:
    """Error table per block and split of any model: ``fit_predict(train, rows)`` returns ``rows`` with ``y_pred``.

    The callable gets the train rows and all rows of *all* blocks, with their block column, and must fit each block on
    its own train rows; a model that fits one table at a time can loop over ``block``.
    """
    scored = fit_predict(samples.filter(q(split) == "train"), samples)
    return scored.groupBy(block, split).agg(*error_table(q(y), F.col("y_pred"), metrics))


def linear_by_block(block: str, y: str, xs: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Least squares per block as a model for ``walk_forward``: all blocks in one pass."""

    def fit_predict(train: DataFrame, rows: DataFrame) -> DataFrame:
        fits = fit_least_squares(train, [block], y, xs).select(block, "coef")
        return rows.join(fits, block).withColumn("y_pred", predict(F.col("coef"), xs)).drop("coef")

    return fit_predict


def numbered(df: DataFrame, groups: Sequence[str], key: str, seed: int) -> DataFrame:
    """``df`` with ``__pos`` (0, 1, ... within the group, in the order of a seeded hash of ``key``) and ``__n``, the group's rows.

    Rows are numbered in sorted ranges of (group, hash); only the ranges' counts are added up, so a group of any size is
    dealt out over all tasks. Staged, because the numbers of rows that tie are those of one run.
    """
    by = [*[q(g) for g in groups], F.xxhash64(q(key), F.lit(seed)), q(key)]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    dealt = staged(dealt.withColumns({"__range": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"), "numbered")
    runs = dealt.groupBy(*groups, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__k"))
    w = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("__k").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*groups, "__range", (before - F.col("__first")).alias("__base"), F.sum("__k").over(w).alias("__n"))
    return dealt.join(runs, [*groups, "__range"]).withColumn("__pos", F.col("__at") + F.col("__base")).drop("__range", "__at", "__base")


#: The constants of XXH64.
PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]

#: Swap-or-not rounds of an index permutation.
PERMUTE_ROUNDS = 24


def _mixed(h: np.ndarray) -> np.ndarray:
    """The last step of XXH64."""
    h = (h ^ (h >> np.uint64(33))) * PRIMES[1]
    h = (h ^ (h >> np.uint64(29))) * PRIMES[2]
    return h ^ (h >> np.uint64(32))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def hashed_int(value: int, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of an int, after columns whose ``xxhash64`` is ``seed``; uint64."""
    return _mixed(_turned((seed + (PRIMES[4] + np.uint64(4))) ^ (np.array([value], np.uint64) * PRIMES[0]), 23) * PRIMES[1] + PRIMES[2])


def hashed_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of longs, after columns whose ``xxhash64`` is ``seed``; uint64."""
    own = _turned(value.astype(np.uint64) * PRIMES[1], 31) * PRIMES[0]
    return _mixed(_turned((seed + (PRIMES[4] + np.uint64(8))) ^ own, 27) * PRIMES[0] + PRIMES[3])


def swapped(pos: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``permuted_index`` of a batch; ``key`` is the hash of the key's columns."""
    x, seed = pos.astype(np.int64), key.astype(np.int64).view(np.uint64)
    for r in range(1, PERMUTE_ROUNDS + 1):
        drawn = hashed_int(r, seed)
        mirror = (drawn.view(np.int64) % n - x) % n
        x = np.where(hashed_long(np.maximum(x, mirror), drawn) & np.uint64(1), mirror, x)
    return x


@F.pandas_udf(T.LongType())
def _permuted(pos: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(swapped(pos.to_numpy(), n.to_numpy(), key.to_numpy()))


def permuted_index(pos: Column, n: Column, *key: Column) -> Column:
    """The place of ``pos`` in a pseudorandom permutation of 0 ... n-1 that the key draws: a bijection, computed row by row.

    In every round a number and its mirror image around a drawn point change places or not, by a hash of the larger one. The
    rounds run on whole batches; a fold of columns is interpreted round by round and took most of the time of an importance.
    """
    return _permuted(pos.cast("long"), n.cast("long"), F.xxhash64(*key))


def permuted(df: DataFrame, key: str, col: str, seed: int) -> DataFrame:
    """The table with one column permuted over all rows."""
    rows = numbered(df, [], key, seed)
    given = rows.select(F.col("__pos").alias("__from"), q(col).alias("__given"))
    taken = rows.withColumn("__from", permuted_index(F.col("__pos"), F.col("__n"), F.lit(seed)))
    return taken.join(given, "__from").withColumn(col, F.col("__given")).select(*[q(c) for c in df.columns])


def permutation_importance(df: DataFrame, key: str, y: str, xs: Sequence[str], score, groups: Sequence[str] = (), repeats: int = 5, seed: int = 7) -> DataFrame:
    """(groups, feature, importance, spread): rise of the mean absolute error when a column is permuted, over the repeats.

    ``score(df)`` adds ``y_pred``; ``key`` identifies a row. Values change places within their group (a split, say). Row i takes
    the values of row p(i), where p is an index permutation drawn for each repeat, so a repeat is one join with the narrow
    columns ``xs``, and each column is put in place in turn and scored. The path is the same at every size.
    """
    groups, xs = list(groups), list(xs)
    rows = numbered(df, groups, key, seed)
    error = F.abs(F.col("y_pred") - q(y))
    given = rows.select(*groups, F.col("__pos").alias("__from"), *[q(x).cast("double").alias(f"__given{i}") for i, x in enumerate(xs)])
    taken = rows.withColumn("__repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    taken = taken.withColumn("__from", permuted_index(F.col("__pos"), F.col("__n"), F.lit(seed), F.col("__repeat")))
    mixed = taken.join(given, [*groups, "__from"])
    for i, x in enumerate(xs):
        own = mixed.withColumn("__own", q(x)).withColumn(x, F.col(f"__given{i}"))
        mixed = score(own).withColumn(f"__e{i}", error).withColumn(x, F.col("__own")).drop("__own", "y_pred")
    loss = mixed.groupBy(*groups, "__repeat").agg(*[F.avg(f"__e{i}").alias(f"__e{i}") for i in range(len(xs))])
    long = loss.select(*groups, F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"__e{i}").alias("loss")) for i, x in enumerate(xs)])).alias("__l")).select(*groups, "__l.*")
    scored = score(rows)
    before = long.join(scored.groupBy(*groups).agg(F.avg(error).alias("base")), groups) if groups else long.withColumn("base", scored.agg(F.avg(error)).scalar())
    rise = before.withColumn("rise", F.col("loss") - F.col("base"))
    return rise.groupBy(*groups, "feature").agg(F.avg("rise").alias("importance"), F.coalesce(F.stddev_pop("rise"), F.lit(0.0)).alias("spread"))
