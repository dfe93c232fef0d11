"""Exact quantiles that never hold a whole column in one place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.spec import q

# At most this many values around a target rank are handed to one exact aggregate.
BRACKET_ROWS = 1_000_000
# Accuracy of the sketch that narrows the bracket (rank error 1 / ACCURACY).
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, probs: Mapping[str, Sequence[float]], bracket_rows: int = BRACKET_ROWS, accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, exact for any size.

    A mergeable rank sketch gives a bracket that must hold the target rank; counting below and inside the
    bracket is a plain aggregate. Brackets with more rows than ``bracket_rows`` are narrowed again (each round
    cuts them by about ``accuracy / 4``); a bracket of one repeated value is already the answer. Only the
    values of a small bracket reach the exact ``percentile``. NULLs are ignored.
    """
    cols = list(probs)
    n = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    targets = []
    for i, c in enumerate(cols):
        for p in probs[c]:
            total = n[f"n{i}"]
            at = (total - 1) * p
            targets.append(
                {"col": c, "k": floor(at), "k2": ceil(at), "frac": at - floor(at), "lo": None, "hi": None, "below": 0, "inside": total}
            )
    filled = [t for t in targets if t["inside"] > 0]
    wide = [t for t in filled if t["inside"] > bracket_rows]
    while wide:
        before = [(t["lo"], t["hi"]) for t in wide]
        ends = df.agg(*[e for i, t in enumerate(wide) for e in _sketch_bracket(t, i, accuracy)]).first()
        for i, t in enumerate(wide):
            t["lo"], t["hi"] = ends[f"lo{i}"], ends[f"hi{i}"]
        counts = df.agg(*[e for i, t in enumerate(wide) for e in _count_bracket(t, i)]).first()
        for i, t in enumerate(wide):
            t["below"], t["inside"] = counts[f"b{i}"], counts[f"i{i}"]
        # A bracket the sketch cannot narrow holds few distinct values, each repeated many times.
        wide = [t for t, b in zip(wide, before) if t["inside"] > bracket_rows and t["lo"] != t["hi"] and (t["lo"], t["hi"]) != b]
    if filled:
        inside = df.select(*[_inside(t).alias(f"x{i}") for i, t in enumerate(filled)])
        got = inside.agg(*[_order_statistic(t, t[k], f"x{i}", f"{k}_{i}") for i, t in enumerate(filled) for k in ("k", "k2")]).first()
        for i, t in enumerate(filled):
            t["a"], t["b"] = float(got[f"k_{i}"]), float(got[f"k2_{i}"])
    out: dict[str, list[float | None]] = {c: [] for c in cols}
    for t in targets:
        out[t["col"]].append(t["a"] + (t["b"] - t["a"]) * t["frac"] if "a" in t else None)
    return out


def _inside(t: dict) -> Column:
    c = q(t["col"])
    return c if t["lo"] is None else F.when((c >= t["lo"]) & (c <= t["hi"]), c)


def _sketch_bracket(t: dict, i: int, accuracy: int) -> list[Column]:
    m = t["inside"]
    slack = 2.0 / accuracy
    low = max((t["k"] - t["below"]) / m - slack, 0.0)
    high = min((t["k2"] - t["below"] + 1) / m + slack, 1.0)
    x = _inside(t)
    return [
        F.percentile_approx(x, F.lit(low), accuracy).alias(f"lo{i}"),
        F.percentile_approx(x, F.lit(high), accuracy).alias(f"hi{i}"),
    ]


def _count_bracket(t: dict, i: int) -> list[Column]:
    c = q(t["col"])
    return [F.count_if(c < t["lo"]).alias(f"b{i}"), F.count_if((c >= t["lo"]) & (c <= t["hi"])).alias(f"i{i}")]


def _order_statistic(t: dict, k: int, x: str, alias: str) -> Column:
    """The value of 0-based rank ``k``, found among the bracket's values."""
    f = (k - t["below"] + 0.5) / t["inside"]
    return F.expr(f"percentile_disc({f!r}D) WITHIN GROUP (ORDER BY {x})").alias(alias)
