import json

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from panelweave.functions import metrics
from panelweave.functions import scalars as s
from panelweave.operators import evaluate as ev
from panelweave.operators import link as ln
from panelweave.operators import models as m
from panelweave.operators.boosting import boost_blocks, boost_settings
from panelweave.operators import penalised as pen
from panelweave.operators.orders import order_predictions
from panelweave.operators.leastsq import coefficient_table, fit_least_squares, group_moments, merge_moments, predict, solve_coefficients, student_p
from panelweave.plans import runs
from panelweave.plans.prepare import SamplePlan
from panelweave.plans.views import SPEC
from panelweave.sources import catalogue as cat
from panelweave.sources import requests as rq
from panelweave.sources import tables as tb


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.2] + [0, 100, -3]
    g = np.arange(240) % 2
    y = 2 + x @ np.array([1.5, -0.3, 4.0]) + g + rng.normal(size=240) * 0.5
    rows = [(int(i), int(k), *map(float, v), float(t)) for i, (k, v, t) in enumerate(zip(g, x, y))]
    return spark.createDataFrame(rows, "id long, g long, a double, b double, c double, y double"), x, g, y


def test_coefficients_and_errors_match_numpy(data):
    df, x, g, y = data
    got = {(r.g, r.term): r for r in coefficient_table(df, ["g"], "y", ["a", "b", "c"]).collect()}
    for k in (0, 1):
        a = np.column_stack([np.ones((g == k).sum()), x[g == k]])
        b, res, *_ = np.linalg.lstsq(a, y[g == k], rcond=None)
        cov = res[0] / (len(a) - 4) * np.linalg.inv(a.T @ a)
        for i, term in enumerate(["(intercept)", "a", "b", "c"]):
            r = got[(k, term)]
            assert (r.coef, r.std_error) == pytest.approx((b[i], np.sqrt(cov[i, i])), rel=1e-6)
    assert got[(0, "a")].p_value < 1e-6


def test_student_tail():
    # Table values: two-sided 5 % points.
    for df, t in ((1, 12.7062), (5, 2.5706), (30, 2.0423), (1000, 1.9623)):
        assert student_p(t, df) == pytest.approx(0.05, abs=2e-5)
    assert student_p(0.0, 7) == pytest.approx(1.0) and student_p(float("inf"), 3) == 0.0


def test_merged_moments_equal_whole_moments(data):
    df, *_ = data
    parts = group_moments(df.withColumn("p", F.col("id") % 7), ["g", "p"], "y", ["a", "b", "c"])
    merged = merge_moments(parts, ["g"], 4).select("g", solve_coefficients("mean", "cross").alias("coef"))
    whole = {r.g: r.coef for r in fit_least_squares(df, ["g"], "y", ["a", "b", "c"]).collect()}
    for r in merged.collect():
        assert r.coef == pytest.approx(whole[r.g], rel=1e-8)


def test_degenerate_fits(spark):
    one = spark.createDataFrame([(1, 2.0, 5.0), (2, 3.0, 1.0), (2, 3.0, 2.0)], "g long, x double, y double")
    got = {r.g: r.coef for r in fit_least_squares(one, ["g"], "y", ["x"]).collect()}
    assert got == {1: [5.0, 0.0], 2: [1.5, 0.0]}


def test_summary(data):
    df, x, g, y = data
    r = m.regression_summary(df, [], "y", ["a", "b", "c"]).first()
    a = np.column_stack([np.ones(240), x])
    e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    r2 = 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))
    assert r.r2 == pytest.approx(r2) and r.adj_r2 == pytest.approx(1 - (1 - r2) * 239 / 236)
    assert r.f_stat == pytest.approx(r2 / 3 / ((1 - r2) / 236))


def test_penalised_fits_meet_their_optimum(spark):
    """Ridge against the closed form, lasso and elastic net by the conditions of the optimum, per block."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.2, 1]
    g = np.arange(300) % 2
    y = x @ [1.0, -0.4, 0.0, 0.5] * np.where(g, 1, 2) + rng.normal(size=300)
    df = spark.createDataFrame([(int(b), *map(float, r), float(t)) for b, r, t in zip(g, x, y)], "g long, a double, b double, c double, d double, y double")
    settings = pen.settings_grid([0.0, 0.05, 0.4], [0.0, 0.5, 1.0], ["none", "standard"])
    for r in pen.penalised_fits(df, ["g"], "y", ["a", "b", "c", "d"], settings).collect():
        own, t = x[g == r.g], y[g == r.g]
        scale = own.std(0) if r.scaler == "standard" else np.ones(4)
        u = (own - own.mean(0)) / scale
        b = np.array(r.coef[1:]) * scale
        grad = u.T @ (t - t.mean() - u @ b) / len(t) - r.reg * (1 - r.elastic) * b
        on = np.abs(b) > 1e-9
        assert np.abs(grad[on] - r.reg * r.elastic * np.sign(b[on])).max(initial=0) < 1e-6
        assert (np.abs(grad[~on]) <= r.reg * r.elastic + 1e-6).all()
        assert r.coef[0] == pytest.approx(t.mean() - own.mean(0) @ r.coef[1:])
        if r.elastic == 0:
            assert b == pytest.approx(np.linalg.solve(u.T @ u / len(t) + r.reg * np.eye(4), u.T @ (t - t.mean()) / len(t)))


def test_search_fits_each_block_on_its_own_train_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(b, s, i, float(v), float((3 if b else -2) * v + 0.1 * rng.normal()), float(rng.normal())) for b in (0, 1) for s, n in (("train", 60), ("val", 20), ("test", 20)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "block long, split string, id long, a double, y double, z double")
    settings = pen.settings_grid([0.0, 1.0], [0.0, 1.0], pen.SCALERS, [1, None])
    trials, errors = pen.search_by_group(df, ["block"], "split", "y", ["a", "z"], settings)
    got = trials.collect()
    assert len(got) == 2 * len(settings) and sum(r.is_best for r in got) == 2
    assert all(min(got, key=lambda r: (r.block != b, r.val_mae, r.setting)).is_best for b in (0, 1))
    # One block's slope is +3, the other's -2: pooled fits could not be this good.
    assert all(r.mae < 0.2 for r in errors.collect()) and errors.count() == 6
    # Changing val and test rows changes no fit.
    other = df.withColumn("y", F.when(F.col("split") == "train", F.col("y")).otherwise(F.col("y") + 100))
    fit = lambda d: sorted(map(str, pen.penalised_fits(d.filter("split = 'train'"), ["block"], "y", ["a", "z"], settings).collect()))
    assert fit(df) == fit(other)
    kept = pen.kept_features(df.filter("split = 'train'"), ["block"], "y", ["z", "a"], 1).collect()
    assert all(r.features == ["a"] for r in kept)


def test_no_sample_is_in_two_splits_of_a_block(spark):
    df = spark.createDataFrame([(c, p, float(c * p)) for c in range(5) for p in range(20)], "comp long, period long, v double")
    s = SamplePlan(df, SPEC, ["v"], ["v"]).window(3, 1).block_rolling_split(6, 2, 2).compute().samples
    assert s.groupBy("block", "comp", "start").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    targets = s.select("block", "split", "comp", F.explode("y.period").alias("p")).groupBy("block", "comp", "p").agg(F.count_distinct("split").alias("n"))
    assert targets.filter("n > 1").count() == 0


def test_any_model_walks_the_blocks(spark):
    df = spark.createDataFrame([(b, s, float(b + i)) for b in range(3) for s in ("train", "val") for i in range(4)], "block long, split string, y double")

    def mean_of_train(train, rows):
        return rows.join(train.groupBy("block").agg(F.avg("y").alias("y_pred")), "block")

    got = m.walk_forward(df, "block", "split", "y", mean_of_train).collect()
    assert len(got) == 6 and all(r.mae == 1.0 for r in got)


def test_wide_frames_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 60))
    y = x[:, 7] * 2 - x[:, 11] + 0.01 * rng.normal(size=400)
    names = [f"x{i}" for i in range(60)]
    df = spark.createDataFrame([(1, *map(float, r), float(t)) for r, t in zip(x, y)], "g long, " + ", ".join(f"{n} double" for n in names) + ", y double")
    assert set(pen.kept_features(df, ["g"], "y", names, 2).first().features) == {"x7", "x11"}


def test_boosted_trees_of_every_block(spark):
    # Blocks of opposite sign: a fit on the other block, or on both, would miss.
    rows = [(f"b{b}", ("train", "train", "val", "test")[i % 4], float(i % 10), (1.0, -1.0)[b] * (i % 10)) for b in (0, 1) for i in range(120)]
    df = spark.createDataFrame(rows, "block string, split string, x double, y double")
    settings = boost_settings({"depth": [3], "step": [0.5, 1.0], "l2": [0.0]})
    scored, trials = boost_blocks(df, "block", "split", "y", ["x"], settings, rounds=3)
    errors = scored.groupBy("block", "split").agg(F.avg(F.abs(F.col("y") - F.col("y_pred"))).alias("mae"), F.count("*").alias("n")).collect()
    assert {(r.block, r.split, r.n) for r in errors} == {(b, s, n) for b in ("b0", "b1") for s, n in (("train", 60), ("val", 30), ("test", 30))}
    assert all(r.mae < 0.5 for r in errors)
    tried = trials.collect()
    assert len(tried) == 4 and sorted(r.block for r in tried if r.is_best) == ["b0", "b1"]


def test_permuted_index_is_a_bijection(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(m.permuted_index(F.col("id"), F.lit(n), F.lit(3))).collect()]
        assert sorted(got) == list(range(n)) and (n < 7 or got != list(range(n)))


def test_importance_within_groups_at_any_partitioning(spark):
    rows = [(i, "ab"[i % 3 == 0], float(i % 17), float(i % 5), 2.0 * (i % 17) + (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, y double")
    score = lambda d: d.withColumn("y_pred", 2 * F.col("a") + F.col("b"))
    one, many = (sorted(map(tuple, m.permutation_importance(df.repartition(p), "id", "y", ["a", "b"], score, ["g"]).collect())) for p in (1, 13))
    # The same values change places; only the order in which errors are added up may differ.
    assert [r[:2] for r in one] == [r[:2] for r in many] and len(one) == 4
    assert [v for r in one for v in r[2:]] == pytest.approx([v for r in many for v in r[2:]], rel=1e-12)
    assert all(a[2] > b[2] > 0 for a, b in zip(one[::2], one[1::2], strict=True))
    numbers = m.numbered(df.repartition(5), ["g"], "id", 1).collect()
    for g in "ab":
        own = [r for r in numbers if r["g"] == g]
        assert sorted(r["__pos"] for r in own) == list(range(len(own))) and {r["__n"] for r in own} == {len(own)}


def test_gbt_queries_cover_every_block(spark):
    from panelweave.plans import queries_models as qm

    blocks = {r[0] for r in qm.signal_samples(spark, SF).select("block").distinct().collect()}
    assert {r["block"] for r in qm.q_gbt_trials(spark, SF).collect()} == blocks and len(blocks) > 1


def test_permuted_column_keeps_its_values(data):
    df, *_ = data
    out = m.permuted(df, "id", "a", 5)
    before = {r.id: r.a for r in df.collect()}
    after = {r.id: r.a for r in out.collect()}
    assert sorted(before.values()) == sorted(after.values()) and sum(before[k] != after[k] for k in before) > 200
    fit = fit_least_squares(df.withColumn("one", F.lit(1)), ["one"], "y", ["a", "b"]).select("one", "coef")
    ready = df.withColumn("one", F.lit(1)).join(fit, "one")
    imp = {r.feature: r.importance for r in m.permutation_importance(ready, "id", "y", ["a", "b"], lambda d: d.withColumn("y_pred", predict(F.col("coef"), ["a", "b"]))).collect()}
    assert imp["a"] > 0 and imp["b"] > 0
    both = m.permutation_importance(ready.withColumn("split", F.col("id") % 2), "id", "y", ["a", "b"], lambda d: d.withColumn("y_pred", predict(F.col("coef"), ["a", "b"])), ["split"]).collect()
    assert len(both) == 4 and all(r.importance > 0 and r.spread > 0 for r in both)


def test_order_predictions_match_direct_fits(spark):
    rng = np.random.default_rng(8)
    walks = {c: np.cumsum(rng.normal(size=30)) + 10 for c in range(5)}
    df = spark.createDataFrame([(c, t, "g", float(v)) for c, w in walks.items() for t, v in enumerate(w)], "comp long, period long, industry string, v double")
    got = {(r.order, r.split, r.comp): r.y_pred for r in order_predictions(df, SPEC, "v", [(0, 1), (2, 0), (2, 1)], {"val": (27, 28), "test": (28, 29)}).collect()}
    for c, w in walks.items():
        for split, last in (("val", 27), ("test", 28)):
            past = w[: last + 1]
            for p, d in ((0, 1), (2, 0), (2, 1)):
                z = np.diff(past) if d else past
                a = np.column_stack([np.ones(len(z) - p), *[z[p - i - 1 : len(z) - i - 1] for i in range(p)]])
                b = np.linalg.lstsq(a, z[p:], rcond=None)[0]
                step = b @ np.array([1.0, *z[::-1][:p]])
                want = past[-1] + step if d else step
                assert got[(f"({p},{d})", split, c)] == pytest.approx(want, rel=1e-6)


def test_metrics(spark):
    t, p = np.array([0.5, -0.2, 0.0, 3.0]), np.array([0.45, 0.1, 0.04, 0.5])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, p)], "t double, p double")
    r = df.agg(*metrics.error_table(F.col("t"), F.col("p"))).first()
    e = np.abs(t - p)
    assert r.mae == pytest.approx(e.mean()) and r.mse == pytest.approx((e**2).mean())
    assert r.huber == pytest.approx(np.where(e <= 1, e**2 / 2, e - 0.5).mean())
    # Signs agree at 0.5 and 3; 0 and 0.04 agree after rounding to one decimal.
    assert r.mda == 0.75 and (r.pos, r.zero, r.neg) == (0.5, 0.25, 0.25)
    assert r.one_minus_mae_ratio == pytest.approx(1 - e.mean() / np.abs(t).mean())


def test_error_histogram_splits_edges(spark):
    errors = [-5.0, -2.0, 0.0, 0.005, 2.0, 9.0]
    df = spark.createDataFrame([(0.0, e) for e in errors], "y_true double, y_pred double").withColumn("k", F.lit(1))
    got = {r.bucket: r.percent for r in ev.error_histogram(df, ["k"]).collect()}
    assert len(got) == 22 and sum(got.values()) == pytest.approx(100)
    sixth = 100 / 6
    assert got[0] == pytest.approx(1.5 * sixth) and got[1] == pytest.approx(0.5 * sixth)
    assert got[10] == pytest.approx(0.5 * sixth) and got[11] == pytest.approx(1.5 * sixth) and got[21] == pytest.approx(1.5 * sixth)


def test_best_candidate_breaks_ties_low(spark):
    df = spark.createDataFrame([("b", 2.0, 0.1), ("b", 1.0, 0.1), ("b", 3.0, 0.2)], "block string, candidate double, mae double")
    assert ev.best_candidate(df, ["block"], "candidate", "mae").first().candidate == 1.0


def test_best_match(spark):
    ent = spark.createDataFrame([(1, "ACME CORP", "A"), (2, "BOLT", "B"), (3, "NONE", "Z")], "id long, name string, tic string")
    links = spark.createDataFrame([("A", 10), ("A", 11), ("A", 10), ("B", 12)], "tic string, key long")
    recs = spark.createDataFrame([(10, "ACME CO"), (11, "ZEBRA"), (12, "BOLT INC")], "key long, conm string")
    got = {r.id: (r.key, r.include_company) for r in ln.best_match(ent, links, recs, "id", "name", "tic", "key", "conm").collect()}
    assert got == {1: (10, True), 2: (12, True), 3: (None, False)}


def test_best_match_with_a_hot_link(spark):
    """One link key leads to most records; the result is that of brute force."""
    from panelweave.functions.scalars import name_similarity

    ent = spark.createDataFrame([(i, f"NAME {i * 37 % 11}", "HOT" if i % 3 == 0 else f"T{i % 5}") for i in range(30)], "id long, name string, tic string")
    links = spark.createDataFrame([("HOT" if k % 2 else f"T{k % 5}", k) for k in range(60)], "tic string, key long")
    recs = spark.createDataFrame([(k, f"NAM {k % 13}") for k in range(60)], "key long, conm string")
    got = {r.id: (r.key, round(r.score, 9)) for r in ln.best_match(ent, links, recs, "id", "name", "tic", "key", "conm").collect()}
    rows = ent.join(links, "tic").join(recs, "key").select("id", "key", name_similarity(F.col("name"), F.col("conm")).alias("s")).collect()
    want = {}
    for r in rows:
        want[r.id] = max(want.get(r.id, (-1, -1)), (r.s, r.key))
    assert got == {i: (k, round(s, 9)) for i, (s, k) in want.items()}


def test_many_to_one_join_insists_on_unique_keys(spark):
    left = spark.createDataFrame([(1, 5.0)], "k long, v double")
    right = spark.createDataFrame([(1, 6.0), (1, 7.0)], "k long, v double")
    with pytest.raises(ValueError):
        ln.join_many_to_one(left, right, ["k"], "_avg")
    assert ln.join_many_to_one(left, right.limit(1), ["k"], "_avg").columns == ["k", "v", "v_avg"]


def test_chunks(spark):
    assert ln.chunk_size(100_000, 50, 25) == 19 and ln.chunk_size(10, 50, 25) == 4
    out = ln.chunk_entities(spark.range(23), "id", 5).orderBy("request_id").collect()
    assert [r.n for r in out] == [5, 5, 5, 5, 3] and out[1].entities == [5, 6, 7, 8, 9]


def test_fiscal_quarter(spark):
    got = [r[0] for r in spark.range(1, 13).orderBy("id").select(s.fiscal_quarter(F.col("id"))).collect()]
    assert got == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4]


def test_catalogue(spark, tmp_path):
    path = tmp_path / "fields.csv"
    path.write_text(
        "Category,Name,Code,Label,Data Type,Variable Type,fillnan_1,fillnan_2\n"
        "P,Beta,B,Beta,time series,ratio,value:1,\n"
        "P,Cost,C,Cost,time series,flow,formula:Sales-Beta,method:approx(other=Sales)\n"
        "G,Country,X,Country,property,category,,\n"
    )
    fields = cat.read_catalogue(spark, str(path), name_col="Label", code_col="Code")
    assert [f.name for f in fields] == ["beta", "cost", "country"]
    assert cat.formula_pairs(fields) == [("cost", "Sales-Beta")]
    assert list(cat.fill_rules(fields)) == ["beta", "cost"] and fields[1].rules[1].others == ["sales"]
    df = cat.with_metadata(spark.createDataFrame([(1.0,)], "beta double"), fields)
    assert df.schema["beta"].metadata["variable_type"] == "ratio"


def test_registry(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    reg = cat.Registry()
    reg.add("x", cat.Dataset(path, SPEC, "id"))
    assert reg.scan(spark, "x").count() == 3
    with pytest.raises(KeyError):
        reg["y"]


def test_append_cache_and_side_files(spark, tmp_path):
    path = str(tmp_path / "sink")
    df = spark.createDataFrame([("", float("nan")), ("a", float("inf")), ("b", 1.0)], "t string, v double")
    tb.append(df, path)
    tb.append(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 6 and back.filter("t IS NULL").count() == 2 and back.filter("v IS NULL").count() == 4

    calls = []

    def build():
        calls.append(1)
        return spark.range(4), spark.range(1)

    for _ in range(2):
        result, _report = tb.cached_result(spark, str(tmp_path / "cache"), {"a": 1}, build)
    assert result.count() == 4 and len(calls) == 1
    tb.cached_result(spark, str(tmp_path / "cache"), {"a": 2}, build)
    assert len(calls) == 2
    assert tb.fingerprint(a=1) != tb.fingerprint(b=1)

    tb.write_side_file(spark, str(tmp_path / "side"), {"cols": ["x"]})
    assert tb.read_side_file(spark, str(tmp_path / "side")) == {"cols": ["x"]}
    loads = []
    for _ in range(2):
        tb.read_through(spark, str(tmp_path / "copy"), lambda: loads.append(1) or spark.range(2))
    assert len(loads) == 1
    csv = tmp_path / "c.csv"
    csv.write_text("a,b\n1,x\n")
    assert tb.read_csv(spark, str(csv), "a int, b string").first().a == 1


def test_status_log(spark, tmp_path):
    path = str(tmp_path / "status")
    rq.set_status(spark, path, 1, rq.OPEN)
    rq.set_status(spark, path, 1, rq.DONE)
    rq.set_status(spark, path, 2, rq.FAILED)
    now = {r.request_id: r.status for r in rq.latest_status(spark.read.parquet(path), "request_id", "last_updated", "status").collect()}
    assert now == {1: rq.DONE, 2: rq.FAILED}


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = runs.log_run(spark, path, "gbt", "b1", {"depth": 3}, {"mae": 0.3})
    b = runs.log_run(spark, path, "gbt", "b1", {"depth": 4}, {"mae": 0.2}, {"note": "x"})
    assert a != b
    best = runs.best_runs(runs.read_runs(spark, path, "mae"), ["name", "block"], "loss", "at").first()
    assert best.run_id == b and json.loads(best.params) == {"depth": 4}


def test_create_table(spark):
    df = spark.createDataFrame([(1, "a")], "k long, t string")
    try:
        assert tb.create_table(df, "panelweave_probe") and not tb.create_table(df, "panelweave_probe")
        assert tb.table_exists(spark, "panelweave_probe")
    finally:
        spark.sql("DROP TABLE IF EXISTS panelweave_probe")
