"""Orders with moving-average terms, elimination by folds and Bayesian ridge against plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from panelweave.operators import penalised as pen
from panelweave.operators.orders import chosen_orders, order_forecasts, order_search
from panelweave.plans.views import SPEC

ORDERS = [(p, d, s) for p in range(3) for d in range(2) for s in range(3)]


def plain_forecast(y: list, n_train: int, p: int, d: int, s: int) -> tuple[float, np.ndarray] | None:
    """(forecast of the value behind the train rows, errors by row) with row-by-row regressions."""
    z = [None if y[i] is None or d and (i == 0 or y[i - 1] is None) else y[i] - (y[i - 1] if d else 0) for i in range(len(y))]

    def fit(rows):
        rows = [(x, t) for x, t in rows if t is not None and all(v is not None for v in x)]
        return np.linalg.lstsq(np.array([[1.0, *x] for x, _ in rows]), np.array([t for _, t in rows]), rcond=1e-12)[0] if rows else None

    back = lambda v, i, n: [v[i - j] if i >= j else None for j in range(1, n + 1)]
    shocks = [None] * len(y)
    if s:
        m = p + s + 1
        long = fit([(back(z, i, m), z[i]) for i in range(n_train)])
        if long is None:
            return None
        shocks = [None if z[i] is None or any(v is None for v in back(z, i, m)) else z[i] - float(long @ [1.0, *back(z, i, m)]) for i in range(len(y))]
    x = [back(z, i, p) + back(shocks, i, s) for i in range(len(y))]
    coef = fit([(x[i], z[i]) for i in range(n_train)])
    if coef is None:
        return None
    guess = [None if any(v is None for v in r) else float(coef @ [1.0, *r]) for r in x]
    error = np.array([np.nan if z[i] is None or guess[i] is None or i >= n_train else z[i] - guess[i] for i in range(len(y))])
    now = guess[n_train]
    return (np.nan if now is None or d and y[n_train - 1] is None else now + (y[n_train - 1] if d else 0)), error


def test_orders_equal_plain_regressions(spark):
    rng = np.random.default_rng(2)
    rows, series = [], {}
    for c in range(6):
        shocks = rng.normal(size=40)
        y = [5.0, 6.0]
        for i in range(2, 40 if c else 7):
            y.append(float(2 + 0.6 * y[-1] - 0.2 * y[-2] + shocks[i] + 0.7 * shocks[i - 1]))
        if c == 2:
            y[11] = None
        series[c] = y
        rows += [(c, t, v) for t, v in enumerate(y)]
    df = spark.createDataFrame([*rows, (9, 38, 1.0), (3, None, 4.0)], "comp long, period long, v double").repartition(3)
    got = {(r["order"], r["split"], r["comp"]): r for r in order_forecasts(df, SPEC, "v", ORDERS, {"val": (37, 38), "test": (38, 39)}).collect()}
    for c, y in series.items():
        for split, n in (("val", 38), ("test", 39)):
            if n >= len(y):
                assert not [k for k in got if k[1:] == (split, c)]
                continue
            plain = {o: plain_forecast(y, n, *o) for o in ORDERS}
            common = np.isfinite(np.stack([p[1] for p in plain.values()])).all(axis=0)
            for o, (forecast, error) in plain.items():
                r = got["(" + ",".join(map(str, o)) + ")", split, c]
                assert r["y_pred"] == pytest.approx(forecast, rel=1e-6) and r["y_true"] == y[n] and r["n"] == common.sum()
                assert r["bic"] == pytest.approx(common.sum() * np.log((error[common] ** 2).mean()) + (1 + o[0] + o[2]) * np.log(common.sum()), rel=1e-6)
    best = chosen_orders(df, SPEC, "v", ORDERS, {"val": (37, 38)}).collect()
    assert {r["comp"]: r["order"] for r in best} == {c: min((r["bic"], r["order"]) for k, r in got.items() if k[1:] == ("val", c))[1] for c in {k[2] for k in got if k[1] == "val"}}
    assert sum(r["is_best"] for r in order_search(df, SPEC, "v", ORDERS, {"val": (37, 38)}).collect()) == 1
    with pytest.raises(ValueError):
        order_forecasts(df, SPEC, "v", [(1, 2)], {})


def some_groups() -> list[tuple]:
    rng = np.random.default_rng(4)
    rows = []
    for g in ("a", "b"):
        x = rng.normal(size=(150, 4)) * [1, 5, 0.2, 1]
        y = (3 * x[:, 0] - (g == "b") * 0.5 * x[:, 1]) + rng.normal(size=150) + 7
        rows += [(g, i, *map(float, r), None if i == 3 else float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return rows


NAMES = ["p", "q", "r", "s"]


def test_elimination_by_folds(spark):
    rows = some_groups()
    df = spark.createDataFrame([*rows, ("lone", 1, 1.0, 1.0, 1.0, 1.0, 2.0)], "g string, id long, p double, q double, r double, s double, y double")
    from pyspark.sql import functions as F

    got = {(r["g"], r["n_features"]): r for r in pen.elimination_folds(df, ["g"], F.col("id") % 4, "y", NAMES).collect()}
    assert got["lone", 1]["cv_mse"] is None and not any(got["lone", c]["is_best"] for c in range(1, 5))
    for g in "ab":
        x = np.array([r[2:6] for r in rows if r[0] == g and r[6] is not None])
        y = np.array([r[6] for r in rows if r[0] == g and r[6] is not None])
        fold = np.array([r[1] % 4 for r in rows if r[0] == g and r[6] is not None])
        errors = {}
        for count in range(1, 5):
            total = 0.0
            for f in range(4):
                tx, ty = x[fold != f], y[fold != f]
                keep = list(range(4))
                while True:
                    b = np.linalg.lstsq(np.c_[np.ones(len(tx)), tx[:, keep]], ty, rcond=None)[0]
                    if len(keep) == count:
                        break
                    keep.pop(int(np.argmin(np.abs(b[1:]) * tx[:, keep].std(axis=0))))
                total += ((y[fold == f] - b[0] - x[fold == f][:, keep] @ b[1:]) ** 2).sum()
            errors[count] = total / len(y)
            assert got[g, count]["cv_mse"] == pytest.approx(errors[count])
        best = min(errors, key=errors.get)
        assert [c for c in errors if got[g, c]["is_best"]] == [best] and {"p"} <= set(got[g, best]["features"])
    assert set(got["b", 2]["features"]) == {"p", "q"}


def test_evidence_is_a_fixed_point(spark):
    rows = some_groups()
    df = spark.createDataFrame(rows, "g string, id long, p double, q double, r double, s double, y double")
    for r in pen.evidence_fits(df, ["g"], "y", NAMES).collect():
        x = np.array([v[2:6] for v in rows if v[0] == r["g"] and v[6] is not None])
        y = np.array([v[6] for v in rows if v[0] == r["g"] and v[6] is not None])
        xc, yc = x - x.mean(axis=0), y - y.mean()
        noise, weight, coef = r["noise_precision"], r["weight_precision"], np.array(r["coef"][1:])
        assert coef == pytest.approx(np.linalg.solve(noise * xc.T @ xc + weight * np.eye(4), noise * xc.T @ yc), rel=1e-6)
        e = np.linalg.eigvalsh(xc.T @ xc)
        effective = np.sum(noise * e / (weight + noise * e))
        assert r["effective"] == pytest.approx(effective, rel=1e-6) and r["n"] == 149
        assert weight == pytest.approx(effective / (coef @ coef), rel=1e-4) and noise == pytest.approx((149 - effective) / ((yc - xc @ coef) ** 2).sum(), rel=1e-4)
        assert r["coef"][0] == pytest.approx(y.mean() - coef @ x.mean(axis=0))
    slopes, noise, weight, *_ = pen.evidence(5, np.zeros(2), np.zeros((2, 2)))
    assert np.isfinite([*slopes, noise, weight]).all()
