import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import scale as sc
from panelweave.operators import windows as win
from panelweave.operators.quantiles import exact_quantiles
from panelweave.operators.radix import from_ordered_bits, grouped_quantiles, with_ordered_bits
from panelweave.operators.select import position_ranges, with_position
from panelweave.plans.prepare import SamplePlan
from panelweave.plans.views import SPEC


def panel(spark, comps=4, periods=20, skip=()):
    rng = np.random.default_rng(0)
    rows = [(c, 2000 + p, float(rng.normal()), float(c * 100 + p)) for c in range(comps) for p in range(periods) if (c, p) not in skip]
    return spark.createDataFrame(rows, "comp long, period long, a double, b double")


def windows_of(spark, n, size, train, val=1, test=1):
    cal = win.calendar(spark.range(n).selectExpr("id AS comp", "id + 2000 AS period"), SPEC)
    return win.windows_table(cal, SPEC, size, train, val, test).collect()


def test_one_block_over_sixteen_years(spark):
    rows = windows_of(spark, 16, win.WindowSize(4, 1), 10)
    assert {r.block for r in rows} == {"2000_2015"}
    spans = {s: sorted((r.lower, r.upper) for r in rows if r.split == s) for s in ("train", "val", "test")}
    assert spans["train"] == [(y, y + 4) for y in range(2000, 2010)]
    assert spans["val"] == [(2010, 2014)] and spans["test"] == [(2011, 2015)]
    assert windows_of(spark, 15, win.WindowSize(4, 1), 10) == []


@pytest.mark.parametrize(("i", "p", "t", "v", "s", "extra"), [(1, 1, 1, 1, 1, 0), (3, 2, 4, 1, 2, 3), (2, 4, 1, 3, 3, 2), (6, 1, 12, 2, 1, 1), (1, 3, 5, 3, 2, 4)])
def test_predicted_periods_of_the_splits_never_meet(spark, i, p, t, v, s, extra):
    size = win.WindowSize(i, p)
    n = (i + t - 1) + 3 * p + v + s - 2 + extra
    rows = windows_of(spark, n, size, t, v, s)
    assert len({r.block for r in rows}) == extra + 1
    for block in {r.block for r in rows}:
        mine = [r for r in rows if r.block == block]
        low, high = map(int, block.split("_"))
        count = {k: sum(r.split == k for r in mine) for k in ("train", "val", "test")}
        assert count == {"train": t, "val": v, "test": s}
        assert all(low <= r.lower and r.upper <= high and r.end - r.start == i + p - 1 and r.lower == 2000 + r.start for r in mine)
        targets = {k: {x for r in mine if r.split == k for x in range(r.upper - p + 1, r.upper + 1)} for k in count}
        assert not targets["train"] & targets["val"] and not targets["val"] & targets["test"] and not targets["train"] & targets["test"]
        assert max(r.upper for r in mine if r.split == "test") == high


def test_shifted_blocks_and_windows(spark):
    rows = windows_of(spark, 16, win.WindowSize(2, 1, 3), 4, 4, 1)
    assert {r.block for r in rows} == {f"{2000 + b}_{2000 + b + 10}" for b in (0, 3)}
    first = sorted((r.split, r.start) for r in rows if r.block == "2000_2010")
    assert first == [("test", 8), ("train", 0), ("train", 3), ("val", 4), ("val", 7)]


def test_samples_and_rejects(spark):
    df = panel(spark, skip={(1, 8), (3, 0)})
    done = SamplePlan(df, SPEC, ["a", "b"], ["b"]).window(3, 2).block_rolling_split(5).compute()
    rows = done.samples.collect()
    assert all(len(r.x) == 3 and len(r.y) == 2 for r in rows)
    for r in rows:
        periods = [s.period for s in r.x] + [s.period for s in r.y]
        assert periods == list(range(r.lower, r.upper + 1))
        assert [s.b for s in r.y] == [r.comp * 100 + p - 2000 for p in periods[3:]]
    windows = {(w.start, w.lower, w.upper) for w in done.windows.collect()}
    rejects = {(r.comp, r.lower) for r in done.rejects.collect()}
    good = {(r.comp, r.lower) for r in rows}
    assert good | rejects == {(c, lo) for c in range(4) for _, lo, _ in windows} and not good & rejects
    assert {lo for c, lo in rejects if c == 1} == {lo for _, lo, up in windows if lo <= 2008 <= up}
    assert len(done) == len(done.blocks()) and done[0].count() == done[done.blocks()[0]].count()


def test_duplicate_rows_are_reported(spark):
    df = panel(spark, comps=2, periods=12)
    twice = df.unionByName(df.filter("comp = 1 AND period = 2003"))
    size = win.WindowSize(3, 1)
    cal = win.calendar(twice, SPEC)
    idx = win.with_index(twice, SPEC, cal)
    windows = win.windows_table(cal, SPEC, size, 4)
    got = win.sample_rejects(idx, SPEC, size, windows).collect()
    assert got and all(r.comp == 1 and "duplicates" in r.message for r in got)
    # Without de-duplication such windows give no sample at all.
    starts = {r.start for r in win.complete_samples(idx, SPEC, size, ["a"], ["b"]).filter("comp = 1").collect()}
    assert starts == {k for k in range(9) if not k <= 3 <= k + 3}


@pytest.mark.parametrize("seed", range(3))
def test_samples_of_a_panel_with_duplicates(spark, seed):
    """Every sample holds exactly the consecutive periods of its window, with the last version of each."""
    rng = np.random.default_rng(seed)
    rows, last = [], {}
    for c in range(4):
        for p in range(14):
            for version in range(int(rng.choice([0, 1, 1, 1, 2, 3]))):
                value = float(rng.normal())
                rows.append((c, 2000 + p, version, value, float("nan") if rng.random() < 0.1 else value))
                last[c, 2000 + p] = value
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(a), int(b), int(v), float(x), float(y)) for a, b, v, x, y in rows], "comp long, period long, version int, a double, b double")
    done = SamplePlan(df, SPEC, ["a", "b"], ["b"], latest_by=["version"]).window(2, 1).block_rolling_split(3).compute()
    got = done.samples.collect()
    windows = {(w.start, w.lower, w.upper) for w in done.windows.collect()}
    periods = sorted({p for _, p in last})
    at = {p: i for i, p in enumerate(periods)}
    want = {(c, lo) for c in range(4) for _, lo, up in windows if all((c, q) in last for q in periods[at[lo] : at[up] + 1])}
    assert {(r.comp, r.lower) for r in got} == want
    for r in got:
        steps = [(s.period, s.a) for s in r.x]
        assert steps == [(q, last[r.comp, q]) for q in periods[at[r.lower] : at[r.lower] + 2]] and [s.period for s in r.y] == [r.upper]
    bad = {(r.comp, r.lower) for r in done.rejects.filter("message NOT LIKE '%duplicates%'").collect()}
    assert bad == {(c, lo) for c in range(4) for _, lo, _ in windows} - want
    raw = {s.b for r in done.samples.collect() for s in r.x}
    scaled = SamplePlan(df, SPEC, ["a", "b"], ["b"], latest_by=["version"]).window(2, 1).block_rolling_split(3).normalize("time").compute()
    assert all(np.isfinite(s.b) for r in scaled.samples.collect() for s in r.x) and not any(x is not None and np.isnan(x) for x in raw)


def test_window_parameters_match_numpy(spark):
    df = panel(spark).selectExpr("comp", "period", "CASE WHEN (comp + period) % 5 = 0 THEN NULL ELSE a END AS a", "b")
    size = win.WindowSize(3, 1)
    cal = win.calendar(df, SPEC)
    idx = win.with_index(df, SPEC, cal)
    windows = win.windows_table(cal, SPEC, size, 5)
    pdf = idx.toPandas()

    def want(rows):
        x = rows["a"].astype(float)
        x = x.fillna(x.mean())
        return x.mean(), x.std(ddof=1)

    for r in sc.norm_by_window(idx, size, ["a"], windows).collect():
        assert (r["mean"], r["std"]) == pytest.approx(want(pdf[(pdf.idx >= r.start) & (pdf.idx < r.start + 4)]))
    for r in sc.norm_by_window_and_entity(idx, SPEC, size, ["a"], windows).collect():
        m, s = want(pdf[(pdf.idx >= r.start) & (pdf.idx < r.start + 4) & (pdf.comp == r.comp)])
        assert (r["mean"], r["std"]) == pytest.approx((m, s))
    assert {r.start for r in sc.norm_by_window(idx, size, ["a"], windows).collect()} == {r.start for r in windows.collect()}
    spans = {}
    for w in windows.filter("split = 'train'").collect():
        lo, hi = spans.get(w.block, (10**9, -1))
        spans[w.block] = (min(lo, w.start), max(hi, w.end))
    got = sc.norm_by_block(idx, windows, ["a"]).collect()
    assert len(got) == len(spans)
    for r in got:
        lo, hi = spans[r.block]
        assert (r["mean"], r["std"]) == pytest.approx(want(pdf[(pdf.idx >= lo) & (pdf.idx <= hi)]))


def test_builder_refuses_bad_settings(spark):
    df = panel(spark)
    with pytest.raises(ValueError):
        SamplePlan(df, SPEC, ["a"], ["b"]).compute()
    with pytest.raises(ValueError):
        SamplePlan(df, SPEC, ["a"], ["b"]).window(3).single_time_rolling().normalize("block")
    with pytest.raises(ValueError):
        SamplePlan(df, SPEC, ["a"], ["b"]).normalize("rank")
    with pytest.raises(ValueError):
        SamplePlan(df, SPEC, ["a"], ["b"]).filter_features(["nothere"])
    with pytest.raises(ValueError):
        SamplePlan(df, SPEC, ["a"], ["b"]).window(0)
    with pytest.raises(ValueError):
        SamplePlan(df, SPEC, ["a"], ["b"]).window(3).normalize("block", exclude_target_periods=True)


def test_block_of_constant_column_scales_to_zero(spark):
    df = panel(spark).selectExpr("comp", "period", "CAST(7 AS DOUBLE) AS a", "b")
    done = SamplePlan(df, SPEC, ["a"], ["b"]).window(3).block_rolling_split(4).normalize("block", keep_raw=["b"]).compute()
    assert {s.a for r in done.samples.collect() for s in r.x} == {0.0}
    assert {s.b for r in done.samples.filter("comp = 2").collect() for s in r.y} <= {200.0 + i for i in range(20)}


def test_static_split_covers_every_row(spark):
    df = panel(spark, comps=10)
    out = SamplePlan(df, SPEC, ["a"], ["b"]).window(3).static_split(0.2, 0.1, 0.1, 0.1).collect()
    assert {(r.comp, r.period) for r in out} == {(c, 2000 + p) for c in range(10) for p in range(20)}
    assert {r.comp for r in out if r.split == "train"} == set(range(8))


@pytest.mark.parametrize("bracket", [5, 50, 100_000])
def test_exact_quantiles(spark, bracket):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=400), np.full(300, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    probs = [0.0, 0.025, 0.31, 0.5, 0.975, 1.0]
    got = exact_quantiles(df, {"v": probs}, bracket_rows=bracket, accuracy=50)["v"]
    assert got == pytest.approx(list(np.quantile(x, probs)), rel=1e-12, abs=1e-12)
    assert exact_quantiles(df.filter("v > 1e12"), {"v": [0.5]})["v"] == [None]


def test_ordered_bits(spark):
    rng = np.random.default_rng(8)
    raw = rng.integers(0, 2**64, 4000, dtype=np.uint64).view(np.float64)
    powers = np.concatenate([np.ldexp(1.0, np.arange(-1074, 1024)), np.nextafter(np.ldexp(1.0, np.arange(-1000, 1024)), 0)])
    x = np.concatenate([raw[~np.isnan(raw)], powers, -powers, [0.0, -0.0, np.inf, -np.inf, np.finfo(float).max, 5e-324]])
    want = np.abs(x).view(np.int64) * np.where(np.signbit(x), -1, 1)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x": x}))
    got = with_ordered_bits(df, ["i"], ["x"]).withColumn("y", from_ordered_bits(F.col("__k0"))).orderBy("i").toPandas()
    assert (got["__k0"].to_numpy() == want).all() and (got["y"].to_numpy() == x).all()
    nan = spark.range(1).select(F.lit(float("nan")).alias("a"), F.lit(None).cast("double").alias("b"))
    assert tuple(with_ordered_bits(nan, [], ["a", "b"]).first()) == (None, None)


@pytest.mark.parametrize(("broadcast", "stage"), [("10MB", True), ("-1", True), ("10MB", False)])
def test_grouped_quantiles(spark, broadcast, stage):
    rng = np.random.default_rng(9)
    rows = [(g, f"h{i % 2}", float(rng.normal() * 10.0 ** rng.integers(-5, 6)), None if i % 3 else -1.0 * i) for i in range(900) for g in ([None] if i % 9 == 0 else ["hot"] if i % 3 else [f"g{i % 7}"])]
    rows += [("hot", "h0", 7.0, None)] * 500 + [("void", "h0", None, None), ("one", "h1", 3.5, float("inf"))]
    df = spark.createDataFrame(rows, "g string, h string, a double, b double").repartition(5)
    probs = {"a": [0.0, 0.02, 0.5, 0.98, 1.0], "b": [0.25, 0.5]}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = {(r.g, r.h, r["column"], r.prob): r.value for r in grouped_quantiles(df, ["g", "h"], probs, stage).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    held = {}
    for g, h, a, b in rows:
        for c, v in (("a", a), ("b", b)):
            if v is not None:
                held.setdefault((g, h, c), []).append(v)
    want = {(*key, p): float(np.quantile(v, p)) for key, v in held.items() for p in probs[key[2]]}
    # One infinite value: NumPy makes it NaN.
    want.update({("one", "h1", "b", p): float("inf") for p in probs["b"]})
    assert set(out) == set(want) and ("void", "h0", "a", 0.5) not in out
    assert all(out[k] == want[k] or out[k] == pytest.approx(want[k], rel=1e-12, abs=1e-15) for k in out)


def test_robust_scaling_by_group(spark):
    rng = np.random.default_rng(10)
    x = {g: rng.normal(size=200) * 10.0**i + i for i, g in enumerate(["p", "q", None])}
    rows = [(g, float(v)) for g, vs in x.items() for v in vs] + [("flat", 2.0)] * 5
    df = spark.createDataFrame([*rows, ("new", 4.0)], "block string, a double")
    params = sc.robust_params_by(df.filter("block IS NULL OR block <> 'new'"), ["block"], ["a"], 0.25, 0.75)
    got = sc.robust_scale_by(df, params, ["block"], ["a"], centering=True).toPandas()
    for g, vs in x.items():
        q1, mid, q3 = np.quantile(vs, [0.25, 0.5, 0.75])
        own = got[got["block"].isna() if g is None else got["block"] == g]["a"]
        assert np.sort(own) == pytest.approx(np.sort((vs - mid) / (q3 - q1)))
    assert set(got[got["block"] == "flat"]["a"]) == {0.0} and list(got[got["block"] == "new"]["a"]) == [4.0]


@pytest.mark.parametrize("parts", [1, 9, None])
def test_positions(spark, parts):
    rng = np.random.default_rng(6)
    keys = rng.permutation(200)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    got = with_position(df, "k", "p", partitions=parts).collect()
    assert all(r.p == r.k for r in got)
    picked = {r.k for r in position_ranges(df, "k", (None, 3), (10, 12), (198, None)).collect()}
    assert picked == {0, 1, 2, 10, 11, 198, 199}


def test_positions_keep_null_and_nan_keys(spark):
    keys = [None, float("nan"), *[float(k) for k in range(40)]]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k double")
    for parts in (1, 9):
        got = {r.i: r.p for r in with_position(df, "k", "p", partitions=parts).collect()}
        assert got == {0: 0, 1: 41, **{i + 2: i + 1 for i in range(40)}}


def test_positions_of_text_keys(spark):
    keys = [f"k{i:04d}" for i in np.random.default_rng(2).permutation(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for parts in (1, 20):
        assert all(r.p == int(r.k[1:]) for r in with_position(df, "k", "p", partitions=parts).collect())


def test_parameters_without_target_periods(spark):
    df = panel(spark)
    done = SamplePlan(df, SPEC, ["a"], ["b"]).window(3, 2).block_rolling_split(4).normalize("time", exclude_target_periods=True).compute(materialise=True)
    pdf = df.toPandas()
    for r in done.norm.filter("feature = 'a' AND start < 10").collect():
        x = pdf[(pdf.period >= 2000 + r.start) & (pdf.period < 2003 + r.start)]["a"]
        assert (r["mean"], r["std"]) == pytest.approx((x.mean(), x.std(ddof=1)))
    card = done.card()
    assert card["settings"]["input_width"] == 3 and card["columns"]["x"] == {0: "a"}


def test_robust_scaling(spark):
    df = panel(spark)
    params = sc.robust_params(df, ["a"], 0.25, 0.75)
    x = np.array([r.a for r in df.collect()])
    q1, mid, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    got = np.sort([r.a for r in sc.robust_scale(df, params, centering=True).collect()])
    assert got == pytest.approx(np.sort((x - mid) / (q3 - q1)))
