import math
import random

import numpy as np
import pytest
from conftest import column, series

from panelweave.operators import ordered as o
from panelweave.plans.views import SPEC

# A series with a gap at each end and one inside.
GAPPY = [None, None, 2, 3, None, None, None, 4, 5, 6, None]


def runs(spark, *values):
    got = o.missing_runs(series(spark, *values), SPEC, "v").orderBy("run_start").collect()
    return [(r.run_start, r.run_end, r.run_case, r.n_filled, r.n_null) for r in got]


def test_missing_runs(spark):
    assert runs(spark, *GAPPY) == [(0, 1, "start", 2, 2), (4, 6, "mid", 5, 3), (10, 10, "end", 3, 1)]
    assert runs(spark, None, None, None) == [(0, 2, "nothing", 0, 3)]
    assert runs(spark, None) == [(0, 0, "nothing", 0, 1)]
    assert runs(spark, 1, 2) == []


def test_linear_fill(spark):
    got = column(o.fill_linear(series(spark, *GAPPY), SPEC, ["v"]), "v")
    assert got == pytest.approx([2, 2, 2, 3, 3.25, 3.5, 3.75, 4, 5, 6, 6])
    assert column(o.fill_linear(series(spark, None, None), SPEC, ["v"]), "v") == [None, None]


def test_annual_fill(spark):
    # Fixed values.
    values = [None] * 5 + [49] * 4 + [45] * 4 + [None] * 4 + [108] * 2
    df = series(spark, *values)
    assert o.annual_flag(df, SPEC, "v").first()["annual"]
    got = column(o.fill_annual_aware(df, SPEC, "v"), "v")
    assert got == pytest.approx([49] * 9 + [45] * 4 + [76.5] * 4 + [108] * 2)


def test_annual_flag_rejects_plain_series(spark):
    assert not o.annual_flag(series(spark, *range(1, 20)), SPEC, "v").first()["annual"]


def yearly(years, shift=0, gaps=()):
    """Quarters of values that hold for a year, beginning ``shift`` quarters into the first one."""
    values = [v for v in years for _ in range(4)][shift:]
    return [None if i in gaps else v for i, v in enumerate(values)]


@pytest.mark.parametrize(
    ("values", "annual"),
    [
        (yearly([1, 2, 3, 4, 5]), True),
        (yearly([5, 1, 4, 2]), True),
        (yearly([1, 2, 3, 4, 5], shift=1), True),
        (yearly([1, 2, 3, 4, 5], shift=3), True),
        (yearly([1, 2, 3, 4, 5, 6], gaps=(2, 9)), True),
        ([1, 2, 3, 4] * 5, False),
        ([1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6], False),
        ([None] * 12, False),
        ([7, None, 3, None, 9, None, 1, None], False),
        (yearly([1, 2])[:5], False),
    ],
)
def test_annual_flag_by_construction(spark, values, annual):
    assert bool(o.annual_flag(series(spark, *values), SPEC, "v").first()["annual"]) == annual


def test_pct_change(spark):
    df = series(spark, 2, None, 4, 0, 5)
    assert column(o.pct_change(df, SPEC, ["v"]), "p_v") == [0, 0, 1, -1, 0]


def test_lag_backfill_stays_inside_the_entity(spark):
    df = series(spark, 1, 2, 3).unionByName(series(spark, 9, comp=2))
    got = column(o.lag_backfill(df, SPEC, ["v"], 1), "v_sft_1")
    # A one-row entity has no lag; it does not borrow the next entity's value.
    assert got == [1, 1, 2, None]


def test_shift_and_lag_set(spark):
    df = series(spark, 1, 2, 3, 4)
    assert column(o.shift_fill(df, SPEC, "v", -1, 0.0, "x"), "x") == [2, 3, 4, 0]
    got = o.lag_set(df, SPEC, {"__all__": [1, 2]})
    assert column(got, "v_sft_2") == [None, None, 1, 2]


@pytest.mark.parametrize("kind", ["flat", "hanning", "hamming", "bartlett", "blackman"])
def test_smooth_matches_convolution(spark, kind):
    x = np.array([3.0, 1, 4, 1, 5, 9, 2, 6])
    n = 5
    w = np.ones(n) if kind == "flat" else getattr(np, kind)(n)
    s = np.concatenate([x[n - 1 : 0 : -1], x, x[-1:-n:-1]])
    want = np.convolve(w / w.sum(), s, mode="valid")
    got = column(o.smooth(series(spark, *x), SPEC, "v", n, kind), "smoothed", ("position",))
    assert got == pytest.approx(list(want))


def test_mask_interpolate_smooth(spark):
    x = np.array([10.0, 11, 50, 12, 13, 12])
    z = (x - x.mean()) / x.std(ddof=1)
    keep = np.abs(z) <= 0.75
    y = np.interp(np.arange(6), np.arange(6)[keep], x[keep])
    s = np.concatenate([y[2:0:-1], y, y[-1:-3:-1]])
    want = np.convolve(np.ones(3) / 3, s, mode="valid")[:6]
    got = column(o.mask_interpolate_smooth(series(spark, *x), SPEC, "v", "out"), "out")
    assert got == pytest.approx(list(want))


def test_fill_never_changes_observed_cells(spark):
    rng = random.Random(3)
    rows = [(c, p, "g", None if rng.random() < 0.4 else rng.random()) for c in range(20) for p in range(15)]
    df = spark.createDataFrame(rows, "comp long, period long, industry string, v double")
    after = {(r.comp, r.period): r.v for r in o.fill_linear(df, SPEC, ["v"]).collect()}
    assert all(v is None or after[(c, p)] == v for c, p, _, v in rows)
    assert not any(v is None or math.isnan(v) for v in after.values())


def test_season(spark):
    df = spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "quarter long")
    got = [(r.t_qrt_sin, r.t_qrt_cos) for r in o.season(df, "quarter").orderBy("quarter").collect()]
    assert got == [(0, 1), (1, 0), (0, -1), (-1, 0)]
