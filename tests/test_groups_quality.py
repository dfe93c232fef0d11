import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import series
from pyspark.sql import functions as F

from panelweave.operators import groups as g
from panelweave.operators import quality as qual
from panelweave.operators import select as sel
from panelweave.operators.gram import pair_correlations
from panelweave.plans.views import SPEC
from panelweave.spec import PanelSpec, as_panel, assert_unique


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows sits in one group."""
    rng = np.random.default_rng(9)
    rows = [(c, p, "hot" if c % 3 == 0 else f"g{c % 7}", float(rng.normal(10, 2)) if rng.random() > 0.2 else None) for c in range(300) for p in (1, 2, 3)]
    return spark.createDataFrame(rows, "comp long, period long, industry string, v double")


def test_compare_to_a_hot_group(hot):
    pdf = hot.toPandas()
    mean = pdf.groupby(["industry", "period"])["v"].transform("mean")
    want = {(r.comp, r.period): int(r.v >= m) for r, m in zip(pdf.itertuples(), mean)}
    got = {(r.comp, r.period): r.v for r in g.compare_to_group(hot, SPEC, ["v"]).collect()}
    assert got == want


def test_salted_join_loses_and_doubles_nothing(hot):
    means = g.group_mean(hot, ["industry", "period"], ["v"], "_avg")
    for salts in (1, 5, 16):
        out = g.join_group(hot, means, ["industry", "period"], "comp", salts=salts)
        assert out.count() == hot.count() and out.filter("v_avg IS NULL").count() == 0


def test_group_levels_have_two_levels(hot):
    out = g.group_levels(hot, SPEC, ["v"]).toPandas()
    pdf = hot.toPandas()
    top = out[out.level == "period"].set_index("period")["v_mean"]
    assert top.to_dict() == pytest.approx(pdf.groupby("period")["v"].mean().to_dict())
    assert len(out[out.level == "industry"]) == pdf.groupby(["industry", "period"]).ngroups


def test_yearly_reduction_prefers_the_later_quarter_on_ties(spark):
    rows = [(1, y * 100 + k, "g", y, k, 1.0) for y in (2000, 2001, 2002) for k in (1, 2, 3, 4)]
    rows += [(2, 200001, "g", 2000, 1, 5.0)]
    df = spark.createDataFrame(rows, "comp long, period long, industry string, data_year long, data_qrt long, eps double")
    out = g.reduce_to_yearly(df, SPEC, "eps", "data_year", "data_qrt").collect()
    # All deviations are 0: quarter 4 wins. The one-row entity has none and goes.
    assert {(r.comp, r.period % 100) for r in out} == {(1, 4)} and len(out) == 3 and all(r.data_qrt == 0 for r in out)


def test_asof_takes_the_last_earlier_key(spark):
    left = spark.createDataFrame([(p,) for p in (1, 2, 3, 5)], "period long")
    right = spark.createDataFrame([(2, "a"), (4, None)], "period long, x string")
    got = {r.period: r.x for r in g.asof_lookup(left, right, "period", ["x"]).collect()}
    assert got == {1: None, 2: "a", 3: "a", 5: None}


def test_quality_thresholds(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, None), (3, None, None), (4, 1.0, 1.0)], "k long, a double, b double")
    assert {r.k: r.data_quality for r in qual.row_fill_rate(df, ["a", "b"]).collect()} == {1: 1, 2: 0.5, 3: 0, 4: 1}
    assert {r.k for r in qual.filter_row_pct(df, ["a", "b"], 0.5).collect()} == {1, 2, 4}
    # The 0.4-quantile of (0, .5, 1, 1) is 0.6.
    assert {r.k for r in qual.filter_row_quantile(df, ["a", "b"], 0.4).collect()} == {1, 4}
    assert qual.drop_sparse_columns(df, 0.6).columns == ["k", "a"]
    assert qual.drop_empty_rows(df, ["k"]).count() == 3


def test_text_cleaning(spark):
    df = spark.createDataFrame([("1.5",), (" ",), ("Infinity",), ("NaN",), ("abc",), (None,)], "t string")
    assert [r.t for r in qual.clean_text_columns(df, ["t"]).collect()] == [1.5, None, None, None, None, None]


def test_infinities(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (2.0,)], "x double")
    assert [r.x for r in qual.clean_infinities(df).collect()] == [None, None, None, 2.0]


def test_dedupe(spark):
    df = spark.createDataFrame([(1, 1, None, 5.0), (1, 2, 3.0, 4.0), (1, 3, 1.0, 2.0), (2, 9, None, None)], "k long, t long, a double, b double")
    assert {(r.k, r.t) for r in qual.dedupe_most_complete(df, ["k"], ["a", "b"], ["t"]).collect()} == {(1, 2), (2, 9)}
    assert {(r.k, r.t) for r in qual.dedupe_last(df, ["k"], ["t"]).collect()} == {(1, 3), (2, 9)}
    plan = qual.dedupe_last(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # a hot key is cut down before the shuffle


def test_as_panel_and_uniqueness(spark):
    df = series(spark, 1, 2).unionByName(series(spark, 9))
    with pytest.raises(ValueError):
        assert_unique(df, ["comp", "period"])
    out = as_panel(df, SPEC, ["v"])
    assert {(r.period, r.v) for r in assert_unique(out, ["comp", "period"]).collect()} == {(1, 9.0), (2, 2.0)}


def test_cell_diff_sees_missing_rows_and_ignores_equal_nulls(spark):
    a = spark.createDataFrame([(1, 1.0, None, "x"), (2, 2.0, None, "y")], "k long, v double, w double, s string").drop("s")
    b = spark.createDataFrame([(1, 1.0, None), (2, 3.0, None), (3, 4.0, None)], "k long, v double, w double")
    got = {(r.k, r.column_name, r.from_value, r.to_value) for r in qual.cell_diff(a, b, ["k"], ["v", "w"]).collect()}
    assert got == {(2, "v", 2.0, 3.0), (3, "v", None, 4.0)}


def test_correlation_prune_counts_dropped_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    rows = [(float(a), float(a + 0.1 * b), float(-a), float(c)) for a, b, c in zip(x, rng.normal(size=200), rng.normal(size=200))]
    df = spark.createDataFrame(rows, "a double, near double, opposite double, other double").withColumn("flat", F.lit(1.0))
    got = {r.column_name: r.dropped for r in qual.correlation_prune(df, ["a", "near", "opposite", "other", "flat"]).collect()}
    assert got == {"a": False, "near": True, "opposite": False, "other": False, "flat": False}


def test_query_builder(spark):
    df = spark.createDataFrame([(i, i % 3, "a" if i % 2 else "b") for i in range(12)], "i long, m long, s string")
    out = sel.build_query(df, ["m"], {"s": "a", "m": [0, 1]}, distinct=True, order_by=["m"])
    assert [r.m for r in out.collect()] == [0, 1]
    assert [r.i for r in sel.build_query(df, ["i"], custom_condition="i > 8", order_by=["i"], limit=1, offset=1).collect()] == [10]


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, c string")
    out = sel.one_hot(df, sel.levels(df, ["c"]), ["k"]).orderBy("k")
    assert out.columns == ["k", "c_y", "c_nan"] and [tuple(r) for r in out.collect()] == [(1, 0, 0), (2, 1, 0), (3, 0, 1)]


def test_examples_do_not_depend_on_partitioning(spark):
    df = spark.range(1000)
    a = {r.id for r in sel.random_examples(df, ["id"], 7, 3).collect()}
    b = {r.id for r in sel.random_examples(df.repartition(9), ["id"], 7, 3).collect()}
    assert a == b and len(a) == 7


def test_custom_spec_names(spark):
    spec = PanelSpec(comp="ric", period="t", industry="sector")
    df = series(spark, 1, 2, 3).toDF("ric", "t", "sector", "v")
    assert g.attach_group_mean(df, spec, ["v"]).count() == 3


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("['a', 'b']", ["a", "b"]),
        ("""["it's", 'say "x"']""", ["it's", 'say "x"']),
        ("['None', None, 'True, False']", ["None", None, "True, False"]),
        (r"['a\'None', None]", ["a'None", None]),
        ("[]", []),
        (None, None),
    ],
)
def test_list_literals(spark, text, want):
    from panelweave.functions.scalars import literal_to_array

    assert spark.createDataFrame([(text,)], "t string").select(literal_to_array(F.col("t"))).first()[0] == want


def test_map_literals(spark):
    from panelweave.functions.scalars import literal_to_map

    df = spark.createDataFrame([("{'a': True, 'b': False, 'c': None}",)], "t string")
    assert df.select(literal_to_map(F.col("t"), "boolean")).first()[0] == {"a": True, "b": False, "c": None}


def wide_frame(spark, rows, columns, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 8)) @ rng.normal(size=(8, columns)) + rng.normal(size=(rows, columns)) + rng.normal(size=columns) * 1e4
    base[rng.random(base.shape) < 0.3] = np.nan
    frame = pd.DataFrame(base, columns=[f"c{i}" for i in range(columns)])
    table = pa.Table.from_pandas(frame, preserve_index=False)  # NaN becomes null
    return frame, spark.createDataFrame(table).repartition(7)


def test_correlations_of_two_hundred_columns_with_gaps(spark):
    frame, df = wide_frame(spark, 1500, 200, 5)
    got = pair_correlations(df, list(frame)).toPandas()
    assert len(got) == 200 * 199 // 2
    there = frame.notna().to_numpy().astype(int)
    counts = pd.DataFrame(there.T @ there, index=list(frame), columns=list(frame))
    want = frame.corr()
    assert all(n == counts.at[a, b] for a, b, n in zip(got.col_a, got.col_b, got.n))
    assert np.abs(got.r - [want.at[a, b] for a, b in zip(got.col_a, got.col_b)]).max() < 1e-9
    plan = pair_correlations(df, list(frame))._jdf.queryExecution().toString()
    assert plan.count("covar") == 0


def test_wide_and_narrow_correlations_agree(spark):
    frame, df = wide_frame(spark, 300, 12, 6)
    # Constant over the rows shared with c0, infinite or NaN somewhere, constant, empty.
    df = df.select(
        "*",
        F.when(F.col("c0").isNull(), F.col("c1")).otherwise(0.1).alias("c12"),
        F.when(F.col("c1") > 0, float("inf")).when(F.col("c2") > 0, float("nan")).otherwise(F.col("c3")).alias("c13"),
        F.lit(7.3).alias("c14"),
        F.lit(None).cast("double").alias("c15"),
    )
    cols = df.columns
    pairs = lambda d: {(r.col_a, r.col_b): r.r for r in d.collect()}
    plain = pairs(qual.correlation_pairs(df, cols))
    wide = pairs(pair_correlations(df, cols).select("col_a", "col_b", F.coalesce("r", F.lit(0.0)).alias("r")))
    assert plain.keys() == wide.keys() and len(cols) == 16
    assert [(k, plain[k], wide[k]) for k in plain if abs(plain[k] - wide[k]) > 1e-9] == []
    assert wide["c0", "c12"] == 0 and wide["c0", "c14"] == 0 and wide["c0", "c15"] == 0


def test_correlations_without_rows(spark):
    df = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(20)))
    assert {r.r for r in qual.correlation_pairs(df, df.columns).collect()} == {0.0}
    assert [(r.n, r.r) for r in pair_correlations(df, df.columns).limit(1).collect()] == [(0, None)]
