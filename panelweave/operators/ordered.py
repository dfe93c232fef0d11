"""Operators over the ordered rows of each entity.

All of them use one window family, ``partitionBy(comp).orderBy(period)``: chained calls share a single
shuffle and sort. Group size is bounded by the number of periods (see ``PanelSpec``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.spec import PanelSpec, numeric_columns, q


def lag_columns(df: DataFrame, spec: PanelSpec, cols: Sequence[str], k: int = 1, suffix: str | None = None) -> DataFrame:
    """Append the value ``k`` rows earlier (row-based, not calendar-based); negative ``k`` looks ahead."""
    suffix = f"_sft_{k}" if suffix is None else suffix
    return df.select("*", *[_shift(q(c), k, spec, None).alias(c + suffix) for c in cols])


def _shift(c: Column, k: int, spec: PanelSpec, fill: float | None) -> Column:
    if k == 0:
        return c
    return (F.lag(c, k, fill) if k > 0 else F.lead(c, -k, fill)).over(spec.ordered())


def shift_fill(df: DataFrame, spec: PanelSpec, col: str, k: int, fill: float | None, alias: str) -> DataFrame:
    """Shift by ``k`` rows in either direction; rows without a source get ``fill``."""
    return df.withColumn(alias, _shift(q(col), k, spec, fill))


def lag_set(
    df: DataFrame, spec: PanelSpec, lags: Mapping[str, Sequence[int]], exclude: Sequence[str] = ()
) -> DataFrame:
    """Many lags in one projection. ``{'__all__': [2, 4]}`` covers every numeric measure not excluded."""
    wanted = {c: list(ks) for c, ks in lags.items() if c != "__all__"}
    if "__all__" in lags:
        skip = {spec.comp, spec.period, *wanted, *exclude}
        for c in numeric_columns(df):
            if c not in skip:
                wanted[c] = list(lags["__all__"])
    for c in exclude:
        wanted.pop(c, None)
    w = spec.ordered()
    return df.select("*", *[F.lag(q(c), k).over(w).alias(f"{c}_sft_{k}") for c, ks in wanted.items() for k in ks])


def pct_change(df: DataFrame, spec: PanelSpec, cols: Sequence[str], prefix: str = "p_", zero_fill: bool = True) -> DataFrame:
    """Append the percent change over the previous row, gaps carried forward first.

    A zero base gives NULL (later 0); with ``zero_fill`` every missing change is 0.
    """
    carried = df.select("*", *[F.last(q(c), ignorenulls=True).over(spec.so_far()).alias(f"__v_{c}") for c in cols])
    w = spec.ordered()

    def change(c: str) -> Column:
        v = q(f"__v_{c}")
        out = F.try_divide(v, F.lag(v).over(w)) - 1
        return (F.coalesce(out, F.lit(0.0)) if zero_fill else out).alias(prefix + c)

    return carried.select(*[q(c) for c in df.columns], *[change(c) for c in cols])


def lag_backfill(df: DataFrame, spec: PanelSpec, cols: Sequence[str], k: int = 1, suffix: str | None = None) -> DataFrame:
    """Lag, then give rows without one the next lag available in the same entity."""
    suffix = f"_sft_{k}" if suffix is None else suffix
    w = spec.ordered()
    lagged = df.select("*", *[F.lag(q(c), k).over(w).alias(f"__l_{c}") for c in cols])
    return lagged.select(
        *[q(c) for c in df.columns],
        *[F.last(q(f"__l_{c}"), ignorenulls=True).over(spec.from_here()).alias(c + suffix) for c in cols],
    )


def missing_runs(df: DataFrame, spec: PanelSpec, col: str) -> DataFrame:
    """Runs of NULL per entity: 0-based start and end row, case, and the counts of the neighbourhood.

    The neighbourhood reaches from the end of the previous run to the start of the next one. Case is
    ``nothing`` for an empty series, ``start`` / ``end`` at the borders and ``mid`` otherwise.
    """
    w = spec.ordered()
    rows = df.select(
        spec.comp,
        spec.period,
        (F.row_number().over(w) - 1).cast("bigint").alias("i"),
        q(col).isNull().alias("gap"),
        F.count(F.lit(1)).over(spec.whole()).alias("n"),
    )
    # A run is named by the number of filled rows before it.
    named = rows.select("*", F.sum((~F.col("gap")).cast("bigint")).over(spec.so_far()).alias("run"))
    runs = (
        named.filter("gap")
        .groupBy(spec.comp, "run")
        .agg(F.min("i").alias("run_start"), F.max("i").alias("run_end"), F.first("n").alias("n"))
    )
    by_run = Window.partitionBy(spec.comp).orderBy("run")
    framed = runs.select(
        "*",
        (F.coalesce(F.lag("run_end").over(by_run), F.lit(-1)) + 1).alias("lo"),
        F.coalesce(F.lead("run_start").over(by_run), F.col("n")).alias("hi"),
    )
    nulls = F.col("run_end") - F.col("run_start") + 1
    filled = F.col("hi") - F.col("lo") - nulls
    case = (
        F.when(filled == 0, "nothing")
        .when(F.col("run_start") == 0, "start")
        .when(F.col("run_end") == F.col("n") - 1, "end")
        .otherwise("mid")
    )
    return framed.select(
        spec.comp, "run_start", "run_end", case.alias("run_case"), filled.alias("n_filled"), nulls.alias("n_null")
    )


def fill_linear(df: DataFrame, spec: PanelSpec, cols: Sequence[str], order: str | None = None) -> DataFrame:
    """Straight line between neighbours by row position; borders take the nearest observed value.

    An empty series stays empty (see ``operators.fill`` for its default).
    """
    spec = PanelSpec(spec.comp, order or spec.period, spec.industry)
    pos = df.withColumn("__i", F.row_number().over(spec.ordered()))

    def around(c: str) -> list[Column]:
        seen = F.when(q(c).isNotNull(), F.col("__i"))
        return [
            F.last(q(c), ignorenulls=True).over(spec.so_far()).alias(f"__a_{c}"),
            F.last(seen, ignorenulls=True).over(spec.so_far()).alias(f"__ia_{c}"),
            F.last(q(c), ignorenulls=True).over(spec.from_here()).alias(f"__b_{c}"),
            F.last(seen, ignorenulls=True).over(spec.from_here()).alias(f"__ib_{c}"),
        ]

    near = pos.select("*", *[e for c in cols for e in around(c)])

    def filled(c: str) -> Column:
        a, ia, b, ib = (q(f"__{k}_{c}") for k in ("a", "ia", "b", "ib"))
        line = a + (b - a) / F.nullif(ib - ia, F.lit(0)) * (F.col("__i") - ia)
        return F.coalesce(q(c), line, a, b).alias(c)

    return near.select(*[filled(c) if c in cols else q(c) for c in df.columns])


def mask_interpolate_smooth(df: DataFrame, spec: PanelSpec, col: str, alias: str, limit: float = 0.75) -> DataFrame:
    """Blank values further than ``limit`` standard deviations from the entity mean, interpolate, then smooth.

    Smoothing is a trailing mean of three rows; the first two rows use reflected values. Entities with fewer
    than three rows are not smoothed.
    """
    c = q(col)
    z = F.try_divide(c - F.avg(c).over(spec.whole()), F.stddev_samp(c).over(spec.whole()))
    masked = df.withColumn("__m", F.when(F.abs(z) > limit, None).otherwise(c))
    line = fill_linear(masked, spec, ["__m"])
    w = spec.ordered()
    m = F.col("__m")
    pos = line.select(
        "*",
        F.row_number().over(w).alias("__r"),
        F.count(F.lit(1)).over(spec.whole()).alias("__n"),
        F.lag(m, 1).over(w).alias("__m1"),
        F.lag(m, 2).over(w).alias("__m2"),
        F.lead(m, 1).over(w).alias("__p1"),
        F.lead(m, 2).over(w).alias("__p2"),
    )
    third = (
        F.when(F.col("__r") == 1, (m + F.col("__p1") + F.col("__p2")) / 3)
        .when(F.col("__r") == 2, (m + F.col("__m1") + m) / 3)
        .otherwise((F.col("__m2") + F.col("__m1") + m) / 3)
    )
    return pos.select(*[q(x) for x in df.columns], F.when(F.col("__n") < 3, m).otherwise(third).alias(alias))


def with_annual_flag(df: DataFrame, spec: PanelSpec, col: str, alias: str = "annual") -> DataFrame:
    """Append, for every row of an entity: is this series yearly data repeated on quarters?

    Two running counters over the rows that have a row four steps ahead: equal to the previous row, and
    "the row four ahead stayed the same as one step ago but differs from this row". The series is annual once
    (changes = 3 and equals > 1), (changes > 1 and equals = 3) or their sum reaches 4.
    """
    w = spec.ordered()
    v = q(col)
    base = df.select(
        "*",
        F.lag(v).over(w).alias("__prev"),
        F.lead(v, 4).over(w).alias("__v4"),
        F.lead(v, 3).over(w).alias("__v4_prev"),
        F.row_number().over(w).alias("__i"),
        F.count(F.lit(1)).over(spec.whole()).alias("__n"),
    )
    i, v4, v4_prev = F.col("__i"), F.col("__v4"), F.col("__v4_prev")
    same = F.coalesce((i > 1) & (F.abs(F.col("__prev") - v) < 0.001), F.lit(False))
    step = F.coalesce((i > 1) & (F.abs(v4_prev - v4) < 0.001) & (F.abs(v4_prev - v) > 0.001), F.lit(False))
    flags = base.select("*", same.alias("__same"), step.alias("__step"))

    def streak(flag: str) -> Column:
        return i - F.coalesce(F.max(F.when(~F.col(flag), i)).over(spec.so_far()), F.lit(0))

    counted = flags.select("*", streak("__same").alias("__e"), streak("__step").alias("__s"))
    e, s = F.col("__e"), F.col("__s")
    hit = (i + 4 <= F.col("__n")) & (((s == 3) & (e > 1)) | ((s > 1) & (e == 3)) | (e + s >= 4))
    return counted.select(*[q(c) for c in df.columns], F.max(hit).over(spec.whole()).alias(alias))


def annual_flag(df: DataFrame, spec: PanelSpec, col: str) -> DataFrame:
    """One row per entity: (comp, annual)."""
    return with_annual_flag(df, spec, col).groupBy(spec.comp).agg(F.max("annual").alias("annual"))


def annual_groups(df: DataFrame, spec: PanelSpec, col: str, alias: str = "year_group") -> DataFrame:
    """Append the number of the four-row group each row belongs to, aligned to the first change of value."""
    w = spec.ordered()
    v = q(col)
    rows = df.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("__i"), F.lag(v).over(w).alias("__p"))
    changed = (F.col("__i") > 0) & (
        F.coalesce(F.abs(F.col("__p") - v) > 0.001, F.lit(False)) | (F.col("__p").isNull() != v.isNull())
    )
    first = rows.select(
        "*", F.coalesce(F.min(F.when(changed, F.col("__i"))).over(spec.whole()) % 4, F.lit(0)).alias("__off")
    )
    group = F.floor((F.col("__i") - F.col("__off") + F.when(F.col("__off") > 0, 4).otherwise(0)) / 4)
    return first.select(*[q(c) for c in df.columns], group.alias(alias))


def fill_annual(df: DataFrame, spec: PanelSpec, col: str, only_where: str | None = None) -> DataFrame:
    """Linear fill of annual-repeat series: one value per four-row group, filled, then spread back.

    Only rows of groups whose first row is empty are filled. ``only_where`` names a boolean column; entities
    without it, or whose group heads have no gap, get the plain ``fill_linear``.
    """
    grouped = annual_groups(df, spec, col, "__g")
    # Groups are runs of rows in period order, so heads are found without sorting by group.
    is_head = F.coalesce(F.col("__g") != F.lag("__g").over(spec.ordered()), F.lit(True))
    flagged = grouped.select("*", is_head.alias("__head"))
    boxed = F.when(F.col("__head"), F.struct(q(col).alias("v")))
    head = flagged.select("*", F.last(boxed, ignorenulls=True).over(spec.so_far())["v"].alias("__own"))
    # Only group heads carry the collapsed series; the group number is their position.
    value = F.when(F.col("__head"), q(col))
    seen = F.when(value.isNotNull(), F.col("__g"))
    near = head.select(
        "*",
        F.last(value, ignorenulls=True).over(spec.so_far()).alias("__ya"),
        F.last(seen, ignorenulls=True).over(spec.so_far()).alias("__yga"),
        F.last(value, ignorenulls=True).over(spec.from_here()).alias("__yb"),
        F.last(seen, ignorenulls=True).over(spec.from_here()).alias("__ygb"),
        F.max(F.col("__own").isNull()).over(spec.whole()).alias("__ygap"),
        q(col).alias("__line"),
    )
    a, ga, b, gb = (F.col(x) for x in ("__ya", "__yga", "__yb", "__ygb"))
    between = a + (b - a) / F.nullif(gb - ga, F.lit(0)) * (F.col("__g") - ga)
    yearly = F.coalesce(q(col), F.when(F.col("__own").isNull(), F.coalesce(between, a, b)))
    if only_where is None:
        return near.select(*[yearly.alias(c) if c == col else q(c) for c in df.columns])
    lined = fill_linear(near, spec, ["__line"])
    out = F.when(q(only_where) & F.col("__ygap"), yearly).otherwise(F.col("__line"))
    return lined.select(*[out.alias(c) if c == col else q(c) for c in df.columns])


def fill_annual_aware(df: DataFrame, spec: PanelSpec, col: str) -> DataFrame:
    """``fill_annual`` for annual-repeat series whose collapsed form has a gap, ``fill_linear`` for the rest."""
    flagged = with_annual_flag(df, spec, col, "__annual")
    return fill_annual(flagged, spec, col, only_where="__annual").drop("__annual")


def smoothing_kernel(window_len: int, kind: str = "flat") -> list[float]:
    """Normalised weights; ``kind`` is flat, hanning, hamming, bartlett or blackman."""
    makers = {"hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman}
    if kind != "flat" and kind not in makers:
        raise ValueError(f"unknown kernel {kind!r}")
    w = np.ones(window_len) if kind == "flat" else makers[kind](window_len)
    return [float(x) for x in w / w.sum()]


def smooth(df: DataFrame, spec: PanelSpec, col: str, window_len: int = 11, kind: str = "hanning") -> DataFrame:
    """Convolve each entity's series, reflected at both ends; gives ``window_len - 1`` extra points.

    Output: (comp, position, smoothed). A series shorter than the window is an error in the contract and is
    returned as NULLs. Windows below 3 return the series itself.
    """
    series = df.groupBy(spec.comp).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(q(spec.period).alias("t"), q(col).alias("v")))), lambda s: s["v"]).alias("x")
    )
    if window_len < 3:
        return series.select(spec.comp, F.posexplode("x").alias("position", "smoothed"))
    kernel = smoothing_kernel(window_len, kind)
    x, n = F.col("x"), F.size("x")
    reach = window_len - 1
    padded = F.concat(F.reverse(F.slice(x, 2, reach)), x, F.slice(F.reverse(x), 1, reach))
    wide = series.select(spec.comp, F.when(n >= window_len, padded).alias("s"), n.alias("n"))
    # The kernel is unrolled: one product per weight, newest value first.
    def at(j: Column) -> Column:
        terms = [F.element_at(F.col("s"), j + (window_len - k)) * F.lit(wt) for k, wt in enumerate(kernel)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    spread = wide.select(spec.comp, "s", F.explode(F.sequence(F.lit(0), F.col("n") + reach - 1)).alias("position"))
    return spread.select(spec.comp, F.col("position").cast("bigint").alias("position"), at(F.col("position")).alias("smoothed"))


def rolling_mean(df: DataFrame, spec: PanelSpec, col: str, periods: int, alias: str) -> DataFrame:
    """Mean of the last ``periods`` rows including this one."""
    return df.withColumn(alias, F.avg(q(col)).over(spec.ordered().rowsBetween(-(periods - 1), 0)))


def keep_last_steps(x: Column, n: int) -> Column:
    """The last ``n`` steps of a sample array."""
    return F.slice(x, -n, n)


def season(df: DataFrame, quarter: str, sin_alias: str = "t_qrt_sin", cos_alias: str = "t_qrt_cos") -> DataFrame:
    from panelweave.functions.scalars import season_cos, season_sin

    return df.select("*", season_sin(q(quarter)).alias(sin_alias), season_cos(q(quarter)).alias(cos_alias))


def distinct_values(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.select(*cols).distinct()
