"""Forecast-error metrics as aggregate Columns: use them in any ``groupBy(...).agg(...)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: guard used by the log and percentage errors.
EPSILON = 1e-7


def mae(t: Column, p: Column) -> Column:
    return F.avg(F.abs(p - t))


def mse(t: Column, p: Column) -> Column:
    return F.avg((p - t) * (p - t))


def msle(t: Column, p: Column) -> Column:
    gap = F.log(F.greatest(t, F.lit(EPSILON)) + 1) - F.log(F.greatest(p, F.lit(EPSILON)) + 1)
    return F.avg(gap * gap)


def mape(t: Column, p: Column) -> Column:
    return F.avg(F.abs(t - p) / F.greatest(F.abs(t), F.lit(EPSILON))) * 100


def huber(t: Column, p: Column, delta: float = 1.0) -> Column:
    gap = F.abs(p - t)
    return F.avg(F.when(gap <= delta, gap * gap * 0.5).otherwise(gap * delta - 0.5 * delta * delta))


def directional_accuracy(t: Column, p: Column, rounding: int = 10) -> Column:
    """Share with equal sign, or equal after rounding (half to even) at 1 / rounding."""
    same = (F.signum(t) == F.signum(p)) | (F.rint(t * rounding) == F.rint(p * rounding))
    return F.avg(F.when(same, 1.0).otherwise(0.0))


def direction_share(t: Column, direction: int) -> Column:
    """Share of truths that are positive (1), zero (0) or negative (-1) after rounding to 6 decimals."""
    return F.avg(F.when(F.signum(F.rint(t * 1000000)) == direction, 1.0).otherwise(0.0))


def one_minus_error_ratio(t: Column, p: Column, kind: str = "mse") -> Column:
    """1 - error / mean absolute truth."""
    upper = {"mse": mse, "mae": mae}[kind](t, p)
    return F.lit(1.0) - F.try_divide(upper, F.avg(F.abs(t)))


ERROR_METRICS = {
    "mae": mae,
    "mse": mse,
    "msle": msle,
    "mape": mape,
    "huber": huber,
    "mda": directional_accuracy,
    "pos": lambda t, p: direction_share(t, 1),
    "zero": lambda t, p: direction_share(t, 0),
    "neg": lambda t, p: direction_share(t, -1),
    "one_minus_mse_ratio": lambda t, p: one_minus_error_ratio(t, p, "mse"),
    "one_minus_mae_ratio": lambda t, p: one_minus_error_ratio(t, p, "mae"),
}


def error_table(t: Column, p: Column, names: tuple[str, ...] | None = None, digits: int | None = None) -> list[Column]:
    """The named metrics as aliased aggregates, in one pass."""
    out = []
    for name in names or tuple(ERROR_METRICS):
        value = ERROR_METRICS[name](t, p)
        out.append((F.round(value, digits) if digits is not None else value).alias(name))
    return out


# Edges of the error histogram.
ERROR_EDGES = (
    -2.0, -1.5, -1.0, -0.5, -0.25, -0.15, -0.10, -0.05, -0.025, -0.01, 0.0,
    0.01, 0.025, 0.05, 0.1, 0.15, 0.25, 0.5, 1.0, 1.5, 2.0,
)


def error_bucket(error: Column) -> Column:
    """Number of the histogram bucket, doubled: even = strictly inside, odd = exactly on the upper edge.

    Values on an edge count half on either side, so they keep a number of their own until
    ``operators.evaluate.error_histogram`` splits them.
    """
    below = sum(((error > F.lit(e)).cast("bigint") for e in ERROR_EDGES[1:]), (error > F.lit(ERROR_EDGES[0])).cast("bigint"))
    on_edge = error.isin(*ERROR_EDGES).cast("bigint")
    return below * 2 + on_edge
