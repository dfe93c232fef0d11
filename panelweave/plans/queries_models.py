"""Queries for the model-side jobs, on the supplier panel: earnings change next quarter from this quarter's signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.metrics import error_table
from panelweave.operators import models as m
from panelweave.operators import penalised as pen
from panelweave.operators.boosting import boost_blocks, boost_settings
from panelweave.operators.leastsq import coefficient_table, fit_least_squares, predict
from panelweave.operators.ordered import pct_change
from panelweave.operators.orders import chosen_orders, order_predictions, order_search
from panelweave.plans.panel_sql import SUPPLIER, with_panels
from panelweave.plans.prepare import SamplePlan
from panelweave.plans.queries_ordered import KEYS
from panelweave.plans.queries_windows import COMPLETE_SQL
from panelweave.plans.registry import query
from panelweave.plans.views import SPEC, panel_supplier
from panelweave.session import cut_lineage, staged
from panelweave.spec import q

SIGNALS = ["p_sales", "p_inventory", "grossmargin", "p_eps"]


def signal_samples(spark, sf_dir):
    """Last input step of every sample, with the next change of earnings as ``target_p_eps``."""
    p = pct_change(panel_supplier(spark, sf_dir), SPEC, ["sales", "inventory", "eps"])
    plan = SamplePlan(p.select(*KEYS, *SIGNALS), SPEC, SIGNALS, ["p_eps"]).window(4, 1).block_rolling_split(10)
    return plan.compute(materialise=True).last_step()


SIGNAL_SQL = (
    COMPLETE_SQL
    + """, ch AS (SELECT comp, idx, grossmargin, coalesce(eps / nullif(lag(eps) OVER w, 0) - 1, 0) AS p_eps FROM pi WINDOW w AS (PARTITION BY comp ORDER BY period)),
ld AS (SELECT comp, idx, lead(grossmargin, 3) OVER w AS x1, lead(p_eps, 3) OVER w AS x2, lead(p_eps, 4) OVER w AS y FROM ch WINDOW w AS (PARTITION BY comp ORDER BY idx)),
sg AS MATERIALIZED (SELECT s.block, s.split, s.comp, ld.x1, ld.x2, ld.y FROM smp s JOIN ld ON ld.comp = s.comp AND ld.idx = s.start)"""
)


@query(
    "q_ols_single",
    with_panels(
        SUPPLIER,
        body=SIGNAL_SQL
        + " SELECT block, count(*) AS n, round(regr_intercept(y, x2), 6) AS intercept, round(regr_slope(y, x2), 6) AS slope, round(regr_r2(y, x2), 6) AS r2 FROM sg WHERE split = 'train' GROUP BY 1",
    ),
)
def q_ols_single(spark, sf_dir):
    train = signal_samples(spark, sf_dir).filter("split = 'train'")
    fit = fit_least_squares(train, ["block"], "target_p_eps", ["p_eps"])
    r2 = m.regression_summary(train, ["block"], "target_p_eps", ["p_eps"]).select("block", F.round("r2", 6).alias("r2"))
    return fit.join(r2, "block").select("block", "n", F.round(F.col("coef")[0], 6).alias("intercept"), F.round(F.col("coef")[1], 6).alias("slope"), "r2")


@query(
    "q_ols_pair",
    with_panels(
        SUPPLIER,
        body=SIGNAL_SQL
        + """, mo AS (SELECT block, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x1, x2) AS c12, var_pop(x1) AS v1, var_pop(x2) AS v2,
                  avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM sg WHERE split = 'train' GROUP BY 1),
b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM mo)
SELECT block, round(my - b1 * m1 - b2 * m2, 6) AS intercept, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM b""",
    ),
)
def q_ols_pair(spark, sf_dir):
    """Two regressors, against the closed-form normal equations."""
    train = signal_samples(spark, sf_dir).filter("split = 'train'")
    fit = fit_least_squares(train, ["block"], "target_p_eps", ["grossmargin", "p_eps"])
    return fit.select("block", *[F.round(F.col("coef")[i], 6).alias(n) for i, n in enumerate(("intercept", "b1", "b2"))])


PAIR = ["grossmargin", "p_eps"]
# Two regressors in closed form: centred sums, slopes, residual variance and the diagonal of the inverse.
PAIR_SQL = """
, mo AS (SELECT block, count(*) AS n, covar_pop(x1, y) * count(*) AS c1, covar_pop(x2, y) * count(*) AS c2, covar_pop(x1, x2) * count(*) AS c12,
                var_pop(x1) * count(*) AS v1, var_pop(x2) * count(*) AS v2, var_pop(y) * count(*) AS vy, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my
         FROM sg WHERE split = 'train' GROUP BY 1),
b AS (SELECT *, v1 * v2 - c12 * c12 AS det, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM mo),
r AS (SELECT *, b1 * c1 + b2 * c2 AS explained, (vy - b1 * c1 - b2 * c2) / (n - 3) AS mse FROM b)"""


@query(
    "q_ols_fit",
    with_panels(
        SUPPLIER,
        body=SIGNAL_SQL
        + PAIR_SQL
        + """,
t AS (SELECT block, n, '(intercept)' AS term, my - b1 * m1 - b2 * m2 AS coef, sqrt(mse * (1.0 / n + (m1 * m1 * v2 - 2 * m1 * m2 * c12 + m2 * m2 * v1) / det)) AS se FROM r
      UNION ALL SELECT block, n, 'grossmargin', b1, sqrt(mse * v2 / det) FROM r UNION ALL SELECT block, n, 'p_eps', b2, sqrt(mse * v1 / det) FROM r)
SELECT block, n, term, round(coef, 6) AS coef, round(se, 6) AS std_error, round(coef / se, 4) AS t_value FROM t""",
    ),
)
def q_ols_fit(spark, sf_dir):
    """Coefficients, standard errors and t values per block."""
    table = coefficient_table(signal_samples(spark, sf_dir).filter("split = 'train'"), ["block"], "target_p_eps", PAIR)
    return table.select("block", "n", "term", F.round("coef", 6).alias("coef"), F.round("std_error", 6).alias("std_error"), F.round("t_value", 4).alias("t_value"))


@query(
    "q_regression_summary",
    with_panels(
        SUPPLIER,
        body=SIGNAL_SQL
        + PAIR_SQL
        + """
SELECT block, n, round(explained / vy, 6) AS r2, round(1 - (1 - explained / vy) * (n - 1) / (n - 3), 6) AS adj_r2, round((explained / 2) / mse, 4) AS f_stat FROM r""",
    ),
)
def q_regression_summary(spark, sf_dir):
    table = m.regression_summary(signal_samples(spark, sf_dir).filter("split = 'train'"), ["block"], "target_p_eps", PAIR)
    return table.select("block", "n", F.round("r2", 6).alias("r2"), F.round("adj_r2", 6).alias("adj_r2"), F.round("f_stat", 4).alias("f_stat"))


@query(
    "q_walk_forward",
    with_panels(
        SUPPLIER,
        body=SIGNAL_SQL
        + """, f AS (SELECT block, regr_intercept(y, x2) AS a, regr_slope(y, x2) AS b FROM sg WHERE split = 'train' GROUP BY 1)
SELECT sg.block, sg.split, round(avg(abs(a + b * x2 - y)), 6) AS mae, round(avg(power(a + b * x2 - y, 2)), 6) AS mse FROM sg JOIN f ON sg.block = f.block GROUP BY 1, 2""",
    ),
)
def q_walk_forward(spark, sf_dir):
    """Fit per block on train, error table on every split - all blocks in one job."""
    out = m.walk_forward(signal_samples(spark, sf_dir), "block", "split", "target_p_eps", m.linear_by_block("block", "target_p_eps", ["p_eps"]))
    return out.select("block", "split", F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"))


@query(
    "q_regularised",
    with_panels(
        SUPPLIER,
        body=SIGNAL_SQL
        + PAIR_SQL
        + """,
z AS (SELECT *, sqrt(v1 / n) AS s1, sqrt(v2 / n) AS s2 FROM r),
g AS (SELECT *, c12 / n / (s1 * s2) AS rho, c1 / n / s1 AS k1, c2 / n / s2 AS k2 FROM z),
h AS (SELECT *, (k1 * 1.1 - k2 * rho) / (1.21 - rho * rho) / s1 AS r1, (k2 * 1.1 - k1 * rho) / (1.21 - rho * rho) / s2 AS r2 FROM g)
SELECT block, n, round(my - r1 * m1 - r2 * m2, 6) AS intercept, round(r1, 6) AS b1, round(r2, 6) AS b2 FROM h""",
    ),
)
def q_regularised(spark, sf_dir):
    """Ridge of two standardised signals, fitted inside each block."""
    train = signal_samples(spark, sf_dir).filter("split = 'train'")
    fits = pen.penalised_fits(train, ["block"], "target_p_eps", PAIR, [pen.Setting(0.1, 0.0, "standard")])
    return fits.select("block", "n", *[F.round(F.col("coef")[i], 6).alias(c) for i, c in enumerate(("intercept", "b1", "b2"))])


# Ridge, mixed and lasso penalties by scaler and number of features.
SEARCH = pen.settings_grid([0.001, 0.01, 0.1], [0.0, 0.5, 1.0], pen.SCALERS, [2, None])


@query("q_grid_search")
def q_grid_search(spark, sf_dir):
    """Every setting in every block, judged by the block's val windows."""
    trials, _ = pen.search_by_group(signal_samples(spark, sf_dir), ["block"], "split", "target_p_eps", SIGNALS, SEARCH)
    return trials


@query("q_penalised_errors")
def q_penalised_errors(spark, sf_dir):
    """Errors of each block's best setting on its three splits."""
    _, errors = pen.search_by_group(signal_samples(spark, sf_dir), ["block"], "split", "target_p_eps", SIGNALS, SEARCH)
    return errors


@query(
    "q_eliminate_features",
    with_panels(
        SUPPLIER,
        body=SIGNAL_SQL + PAIR_SQL + " SELECT block, CASE WHEN abs(b1) * sqrt(v1) <= abs(b2) * sqrt(v2) THEN 'p_eps' ELSE 'grossmargin' END AS kept FROM r",
    ),
)
def q_eliminate_features(spark, sf_dir):
    """Recursive elimination per block, down to one of two signals."""
    kept = pen.kept_features(signal_samples(spark, sf_dir).filter("split = 'train'"), ["block"], "target_p_eps", PAIR, 1)
    return kept.select("block", F.col("features")[0].alias("kept"))


FOLDS = 5
# Every left-out fold: moments of the other rows, both slopes, and the one that elimination leaves.
FOLDS_SQL = """
, fs AS (SELECT *, (comp + start) % 5 AS fold FROM (SELECT s.block, s.comp, s.start, ld.x1, ld.x2, ld.y FROM smp s JOIN ld ON ld.comp = s.comp AND ld.idx = s.start WHERE s.split = 'train')),
fo AS (SELECT DISTINCT block, fold AS out_ FROM fs),
fm AS (SELECT f.block, out_, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
       FROM fs f JOIN fo ON f.block = fo.block AND f.fold <> out_ GROUP BY 1, 2),
fb AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM fm),
fe AS (SELECT *, CASE WHEN abs(b1) * sqrt(v1) <= abs(b2) * sqrt(v2) THEN 0.0 ELSE c1 / v1 END AS s1, CASE WHEN abs(b1) * sqrt(v1) <= abs(b2) * sqrt(v2) THEN c2 / v2 ELSE 0.0 END AS s2 FROM fb),
er AS (SELECT f.block, avg(power(y - my - b1 * (x1 - m1) - b2 * (x2 - m2), 2)) AS two, avg(power(y - my - s1 * (x1 - m1) - s2 * (x2 - m2), 2)) AS one
       FROM fs f JOIN fe ON f.block = fe.block AND f.fold = out_ GROUP BY 1),
wm AS (SELECT block, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM fs GROUP BY 1),
wk AS (SELECT block, CASE WHEN abs(c1 * v2 - c2 * c12) * sqrt(v1) <= abs(c2 * v1 - c1 * c12) * sqrt(v2) THEN 'p_eps' ELSE 'grossmargin' END AS kept FROM wm)
SELECT block, CAST(1 AS INTEGER) AS n_features, round(one, 8) AS cv_mse, kept AS features, one <= two AS is_best FROM er JOIN wk USING (block)
UNION ALL SELECT block, 2, round(two, 8), 'grossmargin,p_eps', two < one FROM er"""


@query("q_eliminate_folds", with_panels(SUPPLIER, body=SIGNAL_SQL + FOLDS_SQL))
def q_eliminate_folds(spark, sf_dir):
    """Feature count of each block by the error on left-out folds, from one pass of moments."""
    train = signal_samples(spark, sf_dir).filter("split = 'train'")
    out = pen.elimination_folds(train, ["block"], (F.col("comp") + F.col("start")) % FOLDS, "target_p_eps", PAIR)
    return out.select("block", "n_features", F.round("cv_mse", 8).alias("cv_mse"), F.array_join("features", ",").alias("features"), "is_best")


@query("q_evidence_ridge")
def q_evidence_ridge(spark, sf_dir):
    """Bayesian ridge of each block: both precisions and the shrunk coefficients."""
    fits = pen.evidence_fits(signal_samples(spark, sf_dir).filter("split = 'train'"), ["block"], "target_p_eps", SIGNALS)
    return fits.select("block", "n", "noise_precision", "weight_precision", "effective", *[F.col("coef")[i].alias(c) for i, c in enumerate(["intercept", *SIGNALS])])


BOOST_GRID = {
    "depth": [1, 2, 3],
    "step": [0.05, 0.1, 0.3],
    "l2": [0.0, 1.0, 10.0],
    "l1": [0.0, 0.1],
    "min_rows": [5, 20, 50],
    "min_gain": [0.0, 0.01],
    "rows": [0.7, 1.0],
    "columns": [0.5, 1.0],
}


def _gbt(spark, sf_dir):
    """Boosted trees of every block: 100 settings over eight parameters, each on its own train, val and test windows."""
    s = signal_samples(spark, sf_dir).select("block", "split", "comp", "start", *SIGNALS, "target_p_eps")
    return boost_blocks(s, "block", "split", "target_p_eps", SIGNALS, boost_settings(BOOST_GRID, 100), rounds=8, patience=2)


@query("q_gbt_fit")
def q_gbt_fit(spark, sf_dir):
    """Boosted trees of each block, chosen on its val windows: error table on its three splits."""
    scored, _ = _gbt(spark, sf_dir)
    return scored.groupBy("block", "split").agg(*error_table(q("target_p_eps"), q("y_pred"), ("mae", "mda", "huber", "pos")))


@query("q_gbt_trials")
def q_gbt_trials(spark, sf_dir):
    """Every setting that was tried in every block, with its error on val."""
    return _gbt(spark, sf_dir)[1]


ORDERS = [(0, 0), (0, 1), (1, 0), (1, 1)]


def _until(p):
    from panelweave.operators.windows import calendar

    last = [r[0] for r in calendar(p, SPEC).orderBy(F.desc("idx")).select(SPEC.period).limit(3).collect()]
    return {"val": (last[2], last[1]), "test": (last[1], last[0])}


AR_SQL = """
, per AS (SELECT period, row_number() OVER (ORDER BY period DESC) AS r FROM (SELECT DISTINCT period FROM panel_supplier)),
z AS (SELECT comp, period, eps AS y, lag(eps) OVER w AS y1, eps - lag(eps) OVER w AS z1 FROM panel_supplier WINDOW w AS (PARTITION BY comp ORDER BY period)),
l AS (SELECT *, lag(y) OVER w AS ly, lag(z1) OVER w AS lz FROM z WINDOW w AS (PARTITION BY comp ORDER BY period)),
s(split, last_r, at_r) AS (VALUES ('val', 3, 2), ('test', 2, 1)),
sp AS (SELECT split, a.period AS last_p, b.period AS at_p FROM s JOIN per a ON a.r = last_r JOIN per b ON b.r = at_r),
f AS (SELECT split, comp, avg(y) AS m0, avg(z1) AS m1, regr_intercept(y, ly) AS a0, regr_slope(y, ly) AS b0, regr_intercept(z1, lz) AS a1, regr_slope(z1, lz) AS b1
      FROM l, sp WHERE l.period <= last_p GROUP BY 1, 2),
j AS (SELECT f.*, l.y, l.y1, l.ly, l.lz FROM l JOIN sp ON l.period = at_p JOIN f ON f.comp = l.comp AND f.split = sp.split),
pred AS (SELECT '(0,0)' AS "order", split, comp, y AS t, m0 AS p FROM j UNION ALL SELECT '(0,1)', split, comp, y, y1 + m1 FROM j
         UNION ALL SELECT '(1,0)', split, comp, y, a0 + b0 * ly FROM j UNION ALL SELECT '(1,1)', split, comp, y, y1 + a1 + b1 * lz FROM j)
"""


@query(
    "q_ar_fit",
    with_panels(
        SUPPLIER,
        body=AR_SQL
        + """, er AS (SELECT "order", split, round(avg(abs(p - t)), 2) AS mae, round(avg((p - t) * (p - t)), 0) AS mse,
       round(avg(CASE WHEN sign(t) = sign(p) OR sign(round_even(t * 10000, 0)) = sign(round_even(p * 10000, 0)) THEN 1.0 ELSE 0.0 END), 6) AS mda,
       round(avg(sign(round_even(t * 1000000, 0))), 6) AS pos FROM pred WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2)
SELECT *, "order" = (SELECT arg_min("order", (mae, "order")) FROM er WHERE split = 'val') AS is_best FROM er""",
    ),
)
def q_ar_fit(spark, sf_dir):
    """Order search: mean errors of one-step forecasts per order and split, best order by val."""
    p = staged(panel_supplier(spark, sf_dir).select(*KEYS, "eps"))
    out = order_search(p, SPEC, "eps", ORDERS, _until(p))
    return out.select("order", "split", F.round("mae", 2).alias("mae"), F.round("mse", 0).alias("mse"), F.round("mda", 6).alias("mda"), F.round("pos", 6).alias("pos"), "is_best")


@query(
    "q_ar_predictions",
    with_panels(
        SUPPLIER,
        body=AR_SQL
        + """SELECT "order", split, comp, round(t, 4) AS y_true, round(p, 4) AS y_pred FROM pred WHERE "order" IN ('(1,0)', '(1,1)') AND t IS NOT NULL AND p IS NOT NULL""",
    ),
)
def q_ar_predictions(spark, sf_dir):
    p = staged(panel_supplier(spark, sf_dir).select(*KEYS, "eps"))
    out = order_predictions(p, SPEC, "eps", [(1, 0), (1, 1)], _until(p))
    return out.select("order", "split", "comp", F.round("y_true", 4).alias("y_true"), F.round("y_pred", 4).alias("y_pred"))


#: All orders with up to two lags, one difference and two moving-average terms.
ARMA_ORDERS = [(p, d, shocks) for p in range(3) for d in range(2) for shocks in range(3)]


@query("q_arma_search")
def q_arma_search(spark, sf_dir):
    """Mean errors of all orders (p, d, q) up to (2, 1, 2) per split, best by val; the panel is read once."""
    p = staged(panel_supplier(spark, sf_dir).select(*KEYS, "eps"))
    return order_search(p, SPEC, "eps", ARMA_ORDERS, _until(p))


@query("q_arma_chosen")
def q_arma_chosen(spark, sf_dir):
    """Every entity's forecast by the order that its own information criterion picks."""
    p = staged(panel_supplier(spark, sf_dir).select(*KEYS, "eps"))
    return chosen_orders(p, SPEC, "eps", ARMA_ORDERS, _until(p))


@query("q_perm_importance")
def q_perm_importance(spark, sf_dir):
    """Rise of the absolute error when a signal is permuted over the rows of train, and of val; five repeats."""
    s = signal_samples(spark, sf_dir)
    fits = fit_least_squares(s.filter("split = 'train'"), ["block"], "target_p_eps", SIGNALS).select("block", "coef")
    rows = s.filter("split IN ('train', 'val')").join(fits, "block").withColumn("row_id", F.concat_ws("/", "block", "split", "comp", "start"))
    rows = rows.select("row_id", "split", *SIGNALS, "target_p_eps", "coef")
    return m.permutation_importance(rows, "row_id", "target_p_eps", SIGNALS, lambda d: d.withColumn("y_pred", predict(F.col("coef"), SIGNALS)), ["split"])


@query(
    "q_residual_quartiles",
    with_panels(
        SUPPLIER,
        body=SIGNAL_SQL
        + """, f AS (SELECT block, regr_intercept(y, x2) AS a, regr_slope(y, x2) AS b FROM sg WHERE split = 'train' GROUP BY 1),
e AS (SELECT y - (a + b * x2) AS e FROM sg JOIN f ON sg.block = f.block WHERE split = 'train')
SELECT round(min(e), 6) AS "min", round(quantile_cont(e, 0.25), 6) AS q1, round(quantile_cont(e, 0.5), 6) AS "median", round(quantile_cont(e, 0.75), 6) AS q3, round(max(e), 6) AS "max" FROM e""",
    ),
)
def q_residual_quartiles(spark, sf_dir):
    train = cut_lineage(signal_samples(spark, sf_dir).filter("split = 'train'").select("block", "p_eps", "target_p_eps"))
    fits = fit_least_squares(train, ["block"], "target_p_eps", ["p_eps"]).select("block", "coef")
    e = train.join(fits, "block").select((q("target_p_eps") - predict(F.col("coef"), ["p_eps"])).alias("e"))
    got = m.residual_quartiles(e, "e")
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(k) for k, v in got.items()])
