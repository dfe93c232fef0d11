"""Normalisation: parameters per window, per window and entity, or per block; and robust / standard scaling.

Parameters are a long table norm(start | block [, comp], feature, mean, std). The standard deviation is the one
of the gap-filled column (gaps take the mean): sqrt(sum (x - m)^2 / (rows - 1)) with rows counting gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.scalars import zero_if_missing
from panelweave.operators.quantiles import exact_quantiles
from panelweave.operators.radix import grouped_quantiles
from panelweave.operators.windows import WindowSize, explode_to_windows
from panelweave.session import staged
from panelweave.spec import PanelSpec, q


def _period_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows, count, mean and centred square sum per key; long, one row per feature."""
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.struct(F.count(q(c)).alias("n"), F.avg(q(c)).alias("m"), (F.var_pop(q(c)) * F.count(q(c))).alias("ss")).alias(c) for c in cols],
    )
    entry = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), q(c).alias("v")) for c in cols]))
    return wide.select(*keys, "rows", entry.alias("e")).select(
        *keys, "rows", "e.feature", F.col("e.v.n").alias("n"), F.col("e.v.m").alias("m"), F.col("e.v.ss").alias("ss")
    )


def _merge(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled mean and std from per-period rows of (rows, n, m, ss), all keyed by ``keys`` and feature.

    A key has a row for each of its periods; they are gathered once and squares are pooled around the pooled mean, which keeps
    the digits that a raw sum of squares would lose.
    """
    held = stats.groupBy(*keys, "feature").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.collect_list(F.struct("n", "m", "ss")).alias("parts"))
    total = lambda of: F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.coalesce(of(p), F.lit(0.0)))
    # Means are taken relative to one of them, so equal values pool to exactly themselves.
    held = held.withColumn("ref", F.array_max(F.transform("parts", lambda p: p["m"])))
    held = held.withColumn("mean", F.col("ref") + F.try_divide(total(lambda p: p["n"] * (p["m"] - F.col("ref"))), F.col("n")))
    ss = total(lambda p: p["ss"] + p["n"] * (p["m"] - F.col("mean")) * (p["m"] - F.col("mean")))
    return held.select(*keys, "feature", "mean", F.sqrt(F.try_divide(F.when(F.col("n") > 0, F.greatest(ss, F.lit(0.0))), F.col("rows") - 1)).alias("std"))


def norm_by_window(df: DataFrame, size: WindowSize, cols: Sequence[str], windows: DataFrame) -> DataFrame:
    """norm(start, feature, mean, std) over all entities, for the starts of ``windows``. Needs ``idx``.

    Rows are reduced to one row per period before any window is formed: the panel is read once and windows only
    add up ``length`` small rows each.
    """
    by_period = _period_stats(df, ["idx"], cols)
    return _merge(explode_to_windows(by_period, size).join(windows.select("start"), "start", "left_semi"), ["start"])


def norm_by_window_and_entity(df: DataFrame, spec: PanelSpec, size: WindowSize, cols: Sequence[str], windows: DataFrame) -> DataFrame:
    """norm(start, comp, feature, mean, std): the same per entity, for the windows that begin with a row of it.

    Moments are taken over a range frame of the entity's rows, by the shuffle that the samples need anyway.
    """
    frame = Window.partitionBy(spec.comp).orderBy("idx").rangeBetween(0, size.length - 1)
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(q(c)).over(frame).alias("mean"),
            (F.var_pop(q(c)).over(frame) * F.count(q(c)).over(frame)).alias("ss"),
        )
        for c in cols
    ]
    wide = df.select(F.col("idx").alias("start"), spec.comp, F.count(F.lit(1)).over(frame).alias("rows"), F.array(*entries).alias("e"))
    long = wide.join(windows.select("start"), "start", "left_semi").select("start", spec.comp, "rows", F.explode("e").alias("e"))
    return long.select("start", spec.comp, "e.feature", "e.mean", F.sqrt(F.try_divide("e.ss", F.col("rows") - 1)).alias("std"))


def norm_by_block(df: DataFrame, windows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """norm(block, feature, mean, std) over everything from the first to the last period of the train windows."""
    spans = (
        windows.filter(F.col("split") == "train")
        .groupBy("block")
        .agg(F.min("start").alias("first"), F.max("end").alias("last"))
        .select("block", F.explode(F.sequence("first", "last")).alias("idx"))
    )
    by_period = _period_stats(df, ["idx"], cols)
    return _merge(by_period.join(spans, "idx"), ["block"])


def widen_norm(norm: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key with ``__mean_<feature>`` and ``__std_<feature>``; missing mean is 0, missing std is 1."""
    aggs = []
    for c in cols:
        hit = F.col("feature") == c
        aggs.append(F.coalesce(F.max(F.when(hit, F.col("mean"))), F.lit(0.0)).alias(f"__mean_{c}"))
        aggs.append(F.coalesce(F.max(F.when(hit, F.col("std"))), F.lit(1.0)).alias(f"__std_{c}"))
    return norm.groupBy(*keys).agg(*aggs)


def scaled(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; anything undefined or not finite is 0."""
    return zero_if_missing(F.try_divide(x - F.coalesce(mean, F.lit(0.0)), F.coalesce(std, F.lit(1.0))))


def unscaled(x: Column, mean: Column, std: Column) -> Column:
    """Back to the original unit."""
    return x * F.coalesce(std, F.lit(1.0)) + F.coalesce(mean, F.lit(0.0))


def scale_samples(samples: DataFrame, norm: DataFrame, keys: Sequence[str], scale_cols: Sequence[str]) -> DataFrame:
    """Apply parameters to the ``x`` and ``y`` arrays; columns outside ``scale_cols`` only lose their NULLs."""
    wide = widen_norm(norm, keys, scale_cols)
    joined = samples.join(wide, list(keys), "left")
    return joined.withColumns({a: _scale_steps(samples, a, scale_cols) for a in ("x", "y")}).select(*samples.columns)


def _scale_steps(samples: DataFrame, name: str, scale_cols: Sequence[str]) -> Column:
    cols = [f for f in samples.schema[name].dataType.elementType.names if f != "period"]

    def one(s: Column) -> Column:
        parts = [s["period"].alias("period")]
        for c in cols:
            if c in scale_cols:
                parts.append(scaled(s[c], q(f"__mean_{c}"), q(f"__std_{c}")).alias(c))
            else:
                parts.append(zero_if_missing(s[c].cast("double")).alias(c))
        return F.struct(*parts)

    return F.transform(F.col(name), one)


def robust_params(train: DataFrame, cols: Sequence[str], low: float = 0.02, high: float = 0.98) -> dict[str, tuple[float, float]]:
    """(median, quantile range) per column, exact. ``low`` and ``high`` are shares between 0 and 1."""
    got = exact_quantiles(train, {c: [low, 0.5, high] for c in cols})
    return {c: (v[1] or 0.0, (v[2] - v[0]) if v[0] is not None and v[2] != v[0] else 1.0) for c, v in got.items()}


def robust_scale(df: DataFrame, params: dict[str, tuple[float, float]], centering: bool = False) -> DataFrame:
    """Divide by the quantile range fitted on train (a zero range counts as 1), optionally minus the median."""
    return df.withColumns(
        {c: ((q(c) - F.lit(mid)) if centering else q(c)) / F.lit(width) for c, (mid, width) in params.items()}
    )


def robust_params_by(train: DataFrame, keys: Sequence[str], cols: Sequence[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row per group with ``__mid_<col>`` and ``__width_<col>``: median and quantile range fitted on the group's own rows."""
    got = grouped_quantiles(train, keys, {c: [low, 0.5, high] for c in cols})
    at = lambda c, p: F.max(F.when((F.col("column") == c) & (F.col("prob") == p), F.col("value")))
    wide = got.groupBy(*[q(k) for k in keys]).agg(*[e for c in cols for e in (at(c, 0.5).alias(f"__mid_{c}"), (at(c, float(high)) - at(c, float(low))).alias(f"__width_{c}"))])
    return staged(wide, "robust-params")


def robust_scale_by(df: DataFrame, params: DataFrame, keys: Sequence[str], cols: Sequence[str], centering: bool = False) -> DataFrame:
    """``robust_scale`` with the parameters of each row's group; a group without parameters keeps its values."""
    other = params.select(*[q(k).alias(f"__p_{k}") for k in keys], *[q(f"__{n}_{c}") for c in cols for n in ("mid", "width")])
    same = F.lit(True)
    for k in keys:
        same = same & q(k).eqNullSafe(q(f"__p_{k}"))
    joined = df.join(other, same, "left")

    def one(c: str) -> Column:
        width = F.coalesce(F.nullif(q(f"__width_{c}"), F.lit(0.0)), F.lit(1.0))
        return ((q(c) - F.coalesce(q(f"__mid_{c}"), F.lit(0.0))) if centering else q(c)) / width

    return joined.withColumns({c: one(c) for c in cols}).select(*[q(c) for c in df.columns])


def standard_params(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[f(q(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def standard_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})
