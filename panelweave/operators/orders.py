"""One-step forecasts of every entity's series by orders (p, d, q), all orders and splits in one pass.

A panel holds one row per entity and period, so an entity's series is an array no longer than the calendar. One shuffle
gathers the series; each is then fitted on its own, for all orders and splits, by least squares on small matrices, stacked
for many series at a time. Series of a stack are padded at their ends.

Orders without moving-average terms are regressions on p lags of the level (d = 0) or of the change (d = 1). Moving-average
terms are fitted in two stages: the residuals of a long autoregression stand for the shocks and are regressors of the second.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.evaluate import best_candidate, mean_forecast_errors
from panelweave.session import cut_lineage
from panelweave.spec import PanelSpec, q


#: Series that are fitted at once.
STACK = 1000


def lagged(z: np.ndarray, n: int) -> np.ndarray:
    """Columns z(t-1) ... z(t-n) of every series of a stack (series, row); NaN before the start."""
    out = np.full((*z.shape, n), np.nan)
    for i in range(1, n + 1):
        out[:, i:, i - 1] = z[:, : z.shape[1] - i]
    return out


def least_squares(x: np.ndarray, z: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intercepts, slopes, whether there is a fit) by series on complete train rows, of least norm where they are not unique."""
    keep = train & np.isfinite(z) & np.isfinite(x).all(axis=2)
    n = np.maximum(keep.sum(axis=1), 1)[:, None]
    mean, centre = np.where(keep[..., None], x, 0.0).sum(axis=1) / n, np.where(keep, z, 0.0).sum(axis=1) / n[:, 0]
    d = np.where(keep[..., None], x - mean[:, None], 0.0)
    turned = d.transpose(0, 2, 1)
    right = turned @ np.where(keep, z - centre[:, None], 0.0)[..., None]
    slopes = (np.linalg.pinv(turned @ d, rcond=1e-12, hermitian=True) @ right)[..., 0] if x.shape[2] else np.zeros((len(z), 0))
    return centre - (slopes * mean).sum(axis=1), slopes, keep.any(axis=1)


def fitted(x: np.ndarray, intercept: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    return intercept[:, None] + (x @ slopes[..., None])[..., 0]


def stack_forecasts(y: np.ndarray, train: np.ndarray, now: np.ndarray, orders: Sequence[tuple[int, int, int]], extra: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forecasts of y at row ``now``, criteria, rows of the criterion) of a stack of series: (series, order) the first two.

    The criterion is the Bayesian one of the errors on the rows that every order can use; errors of levels and of changes are
    both errors of y. It is infinite where an order has no such row. An order without a complete row has no forecast (NaN).
    """
    each = np.arange(len(y))
    before = np.hstack([np.full((len(y), 1), np.nan), y[:, :-1]])
    levels = {d: y - before if d else y for d in {o[1] for o in orders}}
    # The residuals of the long autoregressions; several orders share one.
    shock = {}
    for d, n in {(d, p + s + extra) for p, d, s in orders if s}:
        long = lagged(levels[d], n)
        intercept, slopes, known = least_squares(long, levels[d], train)
        shock[d, n] = levels[d] - fitted(long, intercept, slopes), known
    forecast, common, errors = np.full((len(y), len(orders)), np.nan), train.copy(), []
    for number, (p, d, s) in enumerate(orders):
        z, x, known = levels[d], lagged(levels[d], p), True
        if s:
            residual, known = shock[d, p + s + extra]
            x = np.concatenate([x, lagged(residual, s)], axis=2)
        intercept, slopes, fits = least_squares(x, z, train & known[:, None] if s else train)
        guess = fitted(x, intercept, slopes)
        forecast[:, number] = np.where(fits, (before + guess if d else guess)[each, now], np.nan)
        errors.append(z - guess)
        common &= np.isfinite(errors[-1]) | ~fits[:, None]
    n = common.sum(axis=1)
    sse = np.stack([np.where(common, e, 0.0) ** 2 for e in errors], axis=1).sum(axis=2)
    k, some = np.array([1 + p + s for p, _, s in orders]), np.maximum(n, 1)[:, None]
    criterion = np.where(n[:, None] > 0, n[:, None] * np.log(np.maximum(sse, 1e-300) / some) + k * np.log(some), np.inf)
    return forecast, criterion, n


def _label(order: tuple[int, ...]) -> str:
    return "(" + ",".join(map(str, order)) + ")"


def order_forecasts(df: DataFrame, spec: PanelSpec, col: str, orders: Sequence[tuple[int, ...]], until: Mapping[str, tuple], extra: int = 1) -> DataFrame:
    """(order, split, comp, y_true, y_pred, bic, n): one-step forecasts per entity, order and split; the panel is read once.

    ``until`` maps a split to (last training period, forecast period). Orders are (p, d) or (p, d, q) with d of 0 or 1. Lags are
    taken over the entity's rows. Forecasts that need a missing value, missing truths and rows without a period drop out.
    """
    if any(o[1] not in (0, 1) or min(o) < 0 for o in orders):
        raise ValueError("orders are (p, d[, q]) with d of 0 or 1")
    full = [(o[0], o[1], o[2] if len(o) > 2 else 0) for o in orders]
    names = [_label(o) for o in orders]
    spans = list(until.items())
    point = F.struct(q(spec.period).alias("t"), q(col).cast("double").alias("y"))
    series = df.filter(q(spec.period).isNotNull()).groupBy(q(spec.comp).alias("comp")).agg(F.array_sort(F.collect_list(point)).alias("s"))
    series = series.select("comp", F.transform("s", lambda s: s["t"]).alias("t"), F.transform("s", lambda s: s["y"]).alias("y"))

    def padded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, periods, whether there is a row): a line for each series."""
        n = batch.column("t").value_lengths().to_numpy(zero_copy_only=False)
        held = np.arange(n.max(initial=1)) < n[:, None]
        flat = batch.column("t").flatten().to_numpy(zero_copy_only=False)
        t = np.zeros(held.shape, dtype=flat.dtype)
        y = np.full(held.shape, np.nan)
        t[held], y[held] = flat, batch.column("y").flatten().to_numpy(zero_copy_only=False)
        return y, t, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, STACK) for b in batches for i in range(0, b.num_rows, STACK)):
            y, t, held = padded(batch)
            for split, (last, at) in spans:
                hit = held & (t == at)
                some = np.flatnonzero(hit.any(axis=1))
                if not len(some):
                    continue
                now = hit[some].argmax(axis=1)
                truth = y[some, now]
                forecast, bic, n = stack_forecasts(y[some], (held & (t <= last))[some], now, full, extra)
                i, number = np.nonzero(np.isfinite(forecast) & np.isfinite(truth)[:, None])
                columns = (pa.array(names).take(pa.array(number)), pa.array([split]).take(pa.array(i * 0)), batch.column("comp").take(pa.array(some[i])), truth[i], forecast[i, number], bic[i, number], n[i])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["order", "split", spec.comp, "y_true", "y_pred", "bic", "n"])

    kinds = [T.StringType(), T.StringType(), df.schema[spec.comp].dataType, T.DoubleType(), T.DoubleType(), T.DoubleType(), T.LongType()]
    return series.mapInArrow(run, T.StructType([T.StructField(c, k) for c, k in zip(("order", "split", spec.comp, "y_true", "y_pred", "bic", "n"), kinds, strict=True)]))


def order_predictions(df: DataFrame, spec: PanelSpec, col: str, orders: Sequence[tuple[int, ...]], until: Mapping[str, tuple], extra: int = 1) -> DataFrame:
    """(order, split, comp, y_true, y_pred) of ``order_forecasts``."""
    return order_forecasts(df, spec, col, orders, until, extra).drop("bic", "n")


def order_search(df: DataFrame, spec: PanelSpec, col: str, orders: Sequence[tuple[int, ...]], until: Mapping[str, tuple], extra: int = 1) -> DataFrame:
    """Mean errors per order and split, with the order that is best on val flagged."""
    # A few rows, read twice: kept, so that every series is fitted once.
    errors = cut_lineage(mean_forecast_errors(order_predictions(df, spec, col, orders, until, extra), ["order", "split"]))
    best = best_candidate(errors.filter(F.col("split") == "val"), ["split"], "order", "mae").select(F.col("order").alias("best"))
    return errors.join(best, F.col("order") == F.col("best"), "left").select("order", "split", "mae", "mse", "mda", "pos", F.col("best").isNotNull().alias("is_best"))


def chosen_orders(df: DataFrame, spec: PanelSpec, col: str, orders: Sequence[tuple[int, ...]], until: Mapping[str, tuple], extra: int = 1) -> DataFrame:
    """(split, comp, order, y_true, y_pred, bic): each entity's forecast by its own order of the least criterion, then by name."""
    rows = order_forecasts(df, spec, col, orders, until, extra)
    best = F.min(F.struct("bic", "order", "y_true", "y_pred")).alias("b")
    return rows.groupBy("split", spec.comp).agg(best).select("split", spec.comp, "b.order", "b.y_true", "b.y_pred", "b.bic")
