import numpy as np
import pytest
from conftest import column, series
from pyspark.sql import functions as F

from panelweave.functions.rules import compile_formula, compile_rule, formula_terms, parse_rule, parse_rules, usable_rules
from panelweave.operators import fill as f
from panelweave.plans.clean import clean_panel
from panelweave.plans.views import SPEC


def test_parse():
    assert parse_rule("value:0").body == "0"
    r = parse_rule("method:approx(other=[Sales, EBIT])")
    assert (r.body, r.others) == ("approx", ["sales", "ebit"])
    assert parse_rule("method:linear(or=NaN)").kwargs == {"or": "NaN"}
    assert parse_rule("number:3").kind == "value"
    with pytest.warns(UserWarning):
        assert parse_rule("method:linear(oops)").kwargs == {}
    for bad in ("0", "magic:1", "value:x"):
        with pytest.raises(ValueError):
            parse_rule(bad)


def test_formula_goes_left_to_right(spark):
    df = spark.createDataFrame([(10.0, 4.0, 2.0, None)], "a double, b double, c double, x double")
    assert df.select(compile_formula("a-b/c*100", df.columns)).first()[0] == 300
    assert df.select(compile_formula("-a+b", df.columns)).first()[0] == -6
    assert formula_terms("100-GM*S") == [("+", "100"), ("-", "gm"), ("*", "s")]
    with pytest.raises(ValueError):
        compile_formula("a/nothere", df.columns)


def test_zero_divisor_leaves_the_gap(spark):
    df = spark.createDataFrame([(1.0, 0.0, None)], "a double, b double, x double")
    assert df.select(compile_rule("formula:a/b", "x", df.columns)).first()[0] is None


def test_empty_series_defaults(spark):
    df = series(spark, None, None, None)
    assert column(f.fill_linear_or(df, SPEC, "v"), "v") == [None] * 3
    assert column(f.fill_linear_or(df, SPEC, "v", empty=7.0), "v") == [7.0] * 3


def test_later_rules_see_earlier_fills(spark):
    df = spark.createDataFrame([(1, 1, "g", 5.0, None, None)], "comp long, period long, industry string, a double, b double, c double")
    rules = {"c": parse_rules(["formula:b+a"]), "b": parse_rules(["formula:a*2"])}
    row = f.apply_rules(df, SPEC, rules).first()
    # c needs b, which comes later in the catalogue: the second pass fills it.
    assert (row.b, row.c) == (10.0, 15.0)


def test_blend_matches_direct_formula(spark):
    rng = np.random.default_rng(1)
    rows = [(c, 1, f"g{c % 3}", None if c % 7 == 0 else float(rng.normal(50, 10))) for c in range(40)]
    df = spark.createDataFrame(rows, "comp long, period long, industry string, v double")
    got = {r.industry: r.v for r in f.group_blend(df, SPEC, ["v"]).collect()}
    every = np.array([r[3] for r in rows if r[3] is not None])
    for g in ("g0", "g1", "g2"):
        x = np.array([r[3] for r in rows if r[2] == g and r[3] is not None])
        total = sum(1 for r in rows if r[2] == g)
        ratio = (x.std(ddof=1) / x.mean()) / (every.std(ddof=1) / every.mean())
        score = min(1, len(x) / 10 * len(x) / total) / 3 + (1 - 1 / (1 + np.exp(-ratio + 1))) * 2 / 3
        assert got[g] == pytest.approx(x.mean() * score + every.mean() * (1 - score))


def test_approx_uses_own_rows_then_the_group_inside_the_span(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        lo = 1 + c % 4
        for p in range(lo, lo + 8):
            x1, x2 = (float(v) for v in rng.normal(10, 3, 2))
            y = 3 + (c + 1) * x1 - 2 * x2 + float(rng.normal(0, 0.1))
            gap = c % 5 == 0 or p % 3 == 0
            rows.append((c, p, f"g{c % 2}", x1, x2, None if gap else y))
    df = spark.createDataFrame(rows, "comp long, period long, industry string, x1 double, x2 double, y double")
    for xs in (["x1"], ["x1", "x2"]):
        got = {(r.comp, r.period): r.y for r in f.fill_approx(df, SPEC, "y", xs).collect()}
        pick = lambda r: [r[3], r[4]][: len(xs)]
        for c in range(12):
            mine = [r for r in rows if r[0] == c]
            train = [r for r in mine if r[5] is not None]
            if not train:
                lo, hi = min(r[1] for r in mine), max(r[1] for r in mine)
                train = [r for r in rows if r[2] == mine[0][2] and lo <= r[1] <= hi and r[5] is not None]
            a = np.array([[1, *pick(r)] for r in train])
            b = np.linalg.lstsq(a, np.array([r[5] for r in train]), rcond=None)[0]
            for r in mine:
                want = r[5] if r[5] is not None else float(np.dot([1, *pick(r)], b))
                assert got[(c, r[1])] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_long_formula_catalogue_stays_plannable(spark):
    names = [f"m{i}" for i in range(30)]
    df = spark.createDataFrame([(1, 1, "g", *[1.0 if i % 3 == 0 else None for i in range(30)])], "comp long, period long, industry string, " + ", ".join(f"{n} double" for n in names))
    rules = {names[i]: parse_rules([f"formula:{names[(i * 7 + 1) % 30]}+{names[(i * 11 + 3) % 30]}-{names[(i * 5 + 2) % 30]}", "value:2"]) for i in range(30)}
    row = f.apply_rules(df, SPEC, rules).first()
    assert all(row[n] is not None for n in names)


def test_forecast_missing(spark):
    df = series(spark, 1, 2, 4, 8, 16).withColumn("e1", F.lit(None).cast("double")).withColumn("e2", F.lit(5.0))
    last = f.forecast_missing(df, SPEC, "v", ["e1", "e2"]).filter("period = 5").first()
    assert last.e1 == pytest.approx(32) and last.e2 == 5.0


def test_clean_panel_reports_what_it_drops(spark):
    rows = [(1, 1, "g", 1.0, 2.0), (1, 2, "g", None, 2.0), (2, 1, "g", None, None), (2, 2, "g", float("inf"), 1.0), (3, 1, "g", 4.0, 1.0)]
    df = spark.createDataFrame(rows, "comp long, period long, industry string, a double, b double")
    out, report = clean_panel(df, SPEC, {"a": parse_rules(["value:0"])}, required_before=["b"], row_pct=0.9, score_cols=["a", "b"])
    r = report.first()
    assert (r.n_input, r.dropped_required, r.dropped_fill_rate, r.n_kept) == (5, 1, 2, 2)
    assert sorted((x.comp, x.period) for x in out.collect()) == [(1, 1), (3, 1)]


def test_an_entity_that_changes_its_group_keeps_its_rows(spark):
    rows = [(1, p, "g" if p < 4 else "h", float(p), None) for p in range(6)]
    rows += [(c, p, g, float(p), 2.0 * p + k) for c, g, k in ((2, "g", 0), (3, "h", 1)) for p in range(6)]
    df = spark.createDataFrame(rows, "comp long, period long, industry string, x double, y double")
    out = f.fill_approx(df, SPEC, "y", ["x"])
    assert out.count() == len(rows)
    got = {r.period: r.y for r in out.filter("comp = 1").collect()}
    assert got == pytest.approx({p: 2.0 * p + (p >= 4) for p in range(6)})


def test_rules_match_names_in_any_case_and_report_the_rest(spark):
    df = spark.createDataFrame([(1, 1, "g", None, 2.0)], "comp long, period long, industry string, Sales double, Cost double")
    rules = {"sales": parse_rules(["formula:cost*3"]), "absent": parse_rules(["value:1"]), "COST": parse_rules(["formula:absent+1"])}
    with pytest.warns(UserWarning, match="absent"):
        out = f.apply_rules(df, SPEC, rules, checkpoint=False)
    assert out.first()["Sales"] == 6.0 and out.columns == df.columns
    kept, left_out = usable_rules(rules, df.columns)
    assert set(kept) == {"Sales"} and len(left_out) == 2


def test_column_cut_and_rules_work_together(spark):
    rows = [(1, p, "g", float(p) if p % 2 else None, None if p < 9 else 1.0, float(p)) for p in range(10)]
    df = spark.createDataFrame(rows, "comp long, period long, industry string, a double, sparse double, b double")
    rules = {"a": parse_rules(["formula:b-sparse", "method:linear(or=0)"]), "sparse": parse_rules(["value:0"])}
    out, report = clean_panel(df, SPEC, rules, col_pct=0.4, required_after=["a"], checkpoint=False)
    seen = report.first()
    assert seen.dropped_columns == ["sparse"] and len(seen.skipped_rules) == 2 and seen.dropped_after == 0
    assert "sparse" not in out.columns and out.filter("a IS NULL").count() == 0


def test_clean_panel_is_built_once_per_setting(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "g", None)], "comp long, period long, industry string, a double")
    clean = lambda value, frame=df: clean_panel(frame, SPEC, {"a": parse_rules([f"value:{value}"])}, cache_root=str(tmp_path), cache_key={"input": "t1"}, checkpoint=False)[0].first()["a"]
    assert clean(1) == 1.0 and clean(2) == 2.0
    other = df.withColumn("a", F.lit(9.0))
    assert clean(1, other) == 1.0  # read back: the key names the same input
    with pytest.raises(ValueError):
        clean_panel(df, SPEC, {}, cache_root=str(tmp_path))


def test_a_full_catalogue_of_rules(spark):
    """Ninety rules over two hundred columns run through the cleaning."""
    names = [f"m{i}" for i in range(200)]
    rows = [(c, p, "g", *[float(i + p) if (i + p + c) % 7 else None for i in range(200)]) for c in range(2) for p in range(6)]
    df = spark.createDataFrame(rows, "comp long, period long, industry string, " + ", ".join(f"{n} double" for n in names))
    kinds = ("value:0", "formula:m0+m1", "formula:m2-m3")
    rules = {n: parse_rules([kinds[i % 3]]) for i, n in enumerate(names[:90])}
    out, report = clean_panel(df, SPEC, rules, checkpoint=False)
    got = out.select([F.sum(F.col(n).isNull().cast("int")).alias(n) for n in names[0:90:3]]).first()
    assert set(got) == {0} and out.count() == 12 and report.first().skipped_rules == []
