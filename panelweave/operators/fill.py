"""Rule-driven filling of missing values in a panel."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.rules import LINEAR_METHODS, Rule, compile_formula, usable_rules
from panelweave.operators.groups import group_blend, join_group
from panelweave.operators.leastsq import (
    fit_least_squares,
    group_moments,
    merge_moments,
    predict,
    single_regressor,
    solve_coefficients,
)
from panelweave.operators.ordered import fill_annual, fill_linear, mask_interpolate_smooth, with_annual_flag
from panelweave.session import cut_lineage
from panelweave.spec import PanelSpec, q


def fill_value(df: DataFrame, col: str, value: float) -> DataFrame:
    return df.withColumn(col, F.coalesce(q(col), F.lit(float(value))))


def fill_formula(df: DataFrame, col: str, formula: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(q(col), compile_formula(formula, df.columns)))


def attach_blend(df: DataFrame, spec: PanelSpec, cols: Sequence[str], prefix: str = "__blend_") -> DataFrame:
    """Append the blended group mean of the row's group and period, per column."""
    blend = group_blend(df, spec, cols).select(
        spec.industry, spec.period, *[q(c).alias(prefix + c) for c in cols]
    )
    return join_group(df, blend, [spec.industry, spec.period], spread_by=spec.comp)


def empty_series_values(df: DataFrame, spec: PanelSpec, blend_col: str, alias: str) -> DataFrame:
    """What an empty series receives: the entity's slice of the blended mean, outliers removed and smoothed."""
    return mask_interpolate_smooth(df, spec, blend_col, alias)


def fill_linear_or(
    df: DataFrame, spec: PanelSpec, col: str, empty: float | None = None, blend_col: str | None = None, annual_aware: bool = False
) -> DataFrame:
    """Linear fill; an entity without any value takes ``empty``, or its slice of ``blend_col``, or stays empty."""
    total = df.withColumn("__seen", F.count(q(col)).over(spec.whole()))
    if blend_col is not None:
        total = empty_series_values(total, spec, blend_col, "__empty")
    else:
        total = total.withColumn("__empty", F.lit(empty).cast("double"))
    if annual_aware:
        flagged = with_annual_flag(total, spec, col, "__annual")
        lined = fill_annual(flagged, spec, col, only_where="__annual")
    else:
        lined = fill_linear(total, spec, [col])
    out = F.when(F.col("__seen") == 0, F.col("__empty")).otherwise(q(col))
    return lined.select(*[out.alias(c) if c == col else q(c) for c in df.columns])


def fill_approx(df: DataFrame, spec: PanelSpec, col: str, others: Sequence[str], snapshot: DataFrame | None = None) -> DataFrame:
    """Regress ``col`` on ``others`` over the entity's complete rows and fill every gap with the prediction.

    An entity without a complete row uses the rows of its group inside its own time span. Those spans are
    answered from moments per (group, period): a span adds up at most as many small rows as there are periods,
    so no entity is ever paired with the rows of its group. Training rows come from ``snapshot`` (default: the
    input as it is, before any fill).
    """
    train = snapshot if snapshot is not None else df
    k = len(others) + 1
    coef = single_regressor("mean", "cross") if k == 2 else solve_coefficients("mean", "cross")
    own = fit_least_squares(train, [spec.comp], col, others).select(spec.comp, F.col("coef").alias("__own"))

    spans = train.groupBy(spec.comp, spec.industry).agg(F.min(spec.period).alias("__lo"), F.max(spec.period).alias("__hi"))
    needy = spans.join(own, spec.comp, "left_anti")
    by_period = group_moments(train, [spec.industry, spec.period], col, others).filter(F.col("n") > 0)
    # Distinct spans only: entities with the same group and span share one result.
    wanted = needy.select(spec.industry, "__lo", "__hi").distinct()
    inside = wanted.join(by_period, spec.industry).filter(F.col(spec.period).between(F.col("__lo"), F.col("__hi")))
    span_fit = (
        merge_moments(inside.select(spec.industry, "__lo", "__hi", "n", "mean", "cross"), [spec.industry, "__lo", "__hi"], k)
        .filter(F.col("n") > 0)
        .select(spec.industry, "__lo", "__hi", coef.alias("__group"))
    )
    # An entity that changes its group has a span in each; a row takes the one of its own group.
    borrowed = needy.join(span_fit, [spec.industry, "__lo", "__hi"]).select(spec.comp, spec.industry, "__group")
    joined = df.join(own, spec.comp, "left").join(borrowed, [spec.comp, spec.industry], "left")
    value = F.coalesce(q(col), predict(F.coalesce(F.col("__own"), F.col("__group")), others))
    return joined.select(*[value.alias(c) if c == col else q(c) for c in df.columns])


def needs_blend(rule: Rule) -> bool:
    return rule.kind == "method" and rule.body in LINEAR_METHODS and _empty_default(rule) == "blend"


def _empty_default(rule: Rule) -> float | None | str:
    """What an empty series takes under a linear rule: a number, nothing (None) or 'blend'."""
    default = rule.kwargs.get("or", "").lower()
    if default == "nan":
        return None
    if default not in ("", "mean"):
        return float(default)
    return 0.0 if rule.body == "linear_or_0" else "blend"


def apply_rule(df: DataFrame, spec: PanelSpec, col: str, rule: Rule, annual_aware: bool = True, snapshot: DataFrame | None = None) -> DataFrame:
    """Apply one rule to the gaps ``col`` has now. Blends must be attached beforehand (``attach_blend``)."""
    if rule.kind == "value":
        return fill_value(df, col, float(rule.body))
    if rule.kind == "formula":
        return fill_formula(df, col, rule.body)
    if rule.body in LINEAR_METHODS:
        default = _empty_default(rule)
        if default == "blend":
            return fill_linear_or(df, spec, col, blend_col=f"__blend_{col}", annual_aware=annual_aware)
        return fill_linear_or(df, spec, col, empty=default, annual_aware=annual_aware)
    if rule.body == "approx":
        known = {c.lower(): c for c in df.columns}
        return fill_approx(df, spec, col, [known[x] for x in rule.others], snapshot)
    raise ValueError(f"unknown fill method {rule.body!r}")


def apply_rules(
    df: DataFrame,
    spec: PanelSpec,
    rules: Mapping[str, Sequence[Rule]],
    formula_passes: int = 3,
    full_passes: int = 2,
    annual_aware: bool = True,
    checkpoint: bool = True,
) -> DataFrame:
    """Fill a panel: formula rules ``formula_passes`` times in catalogue order, then all rules ``full_passes`` times.

    Every rule sees what earlier rules filled. Blended means and regressions are taken from the unfilled input.
    Column names match without regard to case; rules about columns that are not there are left out with a warning.
    The plan is cut by a reliable checkpoint after each pass over all rules.
    """
    rules, left_out = usable_rules(rules, df.columns)
    for text in left_out:
        warnings.warn(f"fill rule left out, {text}", stacklevel=2)
    blended = [c for c, rs in rules.items() if any(needs_blend(r) for r in rs)]
    out = attach_blend(df, spec, blended) if blended else df
    formulas = [(c, r) for c, rs in rules.items() for r in rs if r.kind == "formula"]
    for _ in range(formula_passes):
        for c, r in formulas:
            out = apply_rule(out, spec, c, r)
    for _ in range(full_passes):
        for c, rs in rules.items():
            for r in rs:
                out = apply_rule(out, spec, c, r, annual_aware, snapshot=df)
        if checkpoint:
            out = cut_lineage(out)
    return out.select(*[q(c) for c in df.columns])


def forecast_missing(df: DataFrame, spec: PanelSpec, base: str, estimates: Sequence[str], order: int = 1) -> DataFrame:
    """Fill empty estimate columns with the 1..k step autoregressive forecast from the history of ``base``.

    One model per entity on its whole history (least squares on ``order`` lags); a row's forecast starts from
    the values known at that row. Entities too short to fit keep their gaps.
    """
    lags = [f"__lag{i}" for i in range(1, order + 1)]
    w = spec.ordered()
    lagged = df.select("*", *[F.lag(q(base), i).over(w).alias(lags[i - 1]) for i in range(1, order + 1)])
    fits = fit_least_squares(lagged, [spec.comp], base, lags).filter(F.col("n") > order + 1).select(spec.comp, "coef")
    joined = lagged.join(fits, spec.comp, "left")
    history: list[Column] = [q(base), *[q(x) for x in lags[:-1]]]
    for step, col in enumerate(estimates):
        forecast = F.col("coef")[0]
        for i in range(order):
            forecast = forecast + F.col("coef")[i + 1] * history[i]
        name = f"__f{step}"
        joined = joined.withColumn(name, forecast)
        history = [F.col(name), *history[:-1]]
    return joined.select(
        *[
            F.coalesce(q(c), F.col(f"__f{list(estimates).index(c)}")).alias(c) if c in estimates else q(c)
            for c in df.columns
        ]
    )
