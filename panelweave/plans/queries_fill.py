"""Queries for rule-driven filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.rules import parse_rules
from panelweave.operators import fill as f
from panelweave.operators import quality as qual
from panelweave.operators.ordered import pct_change
from panelweave.plans.panel_sql import CUSTOMER, EVENT, SUPPLIER, with_panels
from panelweave.plans.queries_ordered import EMPTY_SERIES_SQL, FILL_LINEAR_SQL
from panelweave.plans.queries_quality import FILLED
from panelweave.plans.registry import query
from panelweave.session import cut_lineage
from panelweave.plans.views import EVENT_MEASURES, SPEC, panel_customer, panel_event, panel_supplier

KEYS = ["comp", "period"]


@query("q_fill_value", with_panels(CUSTOMER, body="SELECT comp, period, coalesce(sales, 0) AS sales, coalesce(n_orders, 0) AS n_orders FROM panel_customer"))
def q_fill_value(spark, sf_dir):
    p = panel_customer(spark, sf_dir).select(*KEYS, "sales", F.col("n_orders").cast("double").alias("n_orders"))
    rules = {"sales": parse_rules(["value:0"]), "n_orders": parse_rules(["value:0"])}
    return f.apply_rules(p, SPEC, rules, formula_passes=0, full_passes=1, checkpoint=False)


@query(
    "q_fill_formula",
    with_panels(
        EVENT,
        body="""
SELECT comp, period, coalesce(purchase, (click - viewed) / nullif(error, 0) * 100) AS purchase, coalesce(click, (0 - viewed) + purchase) AS click
FROM panel_event""",
    ),
)
def q_fill_formula(spark, sf_dir):
    p = panel_event(spark, sf_dir)
    # Both formulas read the unfilled columns here, as one projection.
    from panelweave.functions.rules import compile_rule

    return p.select(
        *KEYS,
        compile_rule("formula:click-viewed/error*100", "purchase", p.columns).alias("purchase"),
        compile_rule("formula:-viewed+purchase", "click", p.columns).alias("click"),
    )


@query(
    "q_fill_linear_or",
    with_panels(
        CUSTOMER,
        body=FILL_LINEAR_SQL
        + "SELECT comp, period, coalesce(sales, a + (z - a) / nullif(iz - ia, 0) * (i - ia), a, z, 0) AS sales FROM n",
    ),
)
def q_fill_linear_or(spark, sf_dir):
    p = panel_customer(spark, sf_dir).select(*KEYS, "industry", "sales")
    return f.fill_linear_or(p, SPEC, "sales", empty=0.0).select(*KEYS, "sales")


@query(
    "q_fill_linear_blend",
    with_panels(
        EVENT,
        body=EMPTY_SERIES_SQL
        + """
, x AS (SELECT e.comp, e.period, e.error, b.blend, row_number() OVER w AS i, count(*) OVER (PARTITION BY e.comp) AS n,
               count(e.error) OVER (PARTITION BY e.comp) AS seen,
               avg(blend) OVER (PARTITION BY e.comp) AS m, stddev_samp(blend) OVER (PARTITION BY e.comp) AS sd
        FROM panel_event e JOIN blend b ON e.industry = b.industry AND e.period = b.period
        WINDOW w AS (PARTITION BY e.comp ORDER BY e.period)),
y AS (SELECT *, CASE WHEN seen > 0 THEN error WHEN abs((blend - m) / nullif(sd, 0)) > 0.75 THEN NULL ELSE blend END AS v FROM x),
z AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia,
             first_value(v IGNORE NULLS) OVER f AS c, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ic
      FROM y WINDOW b AS (PARTITION BY comp ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    f AS (PARTITION BY comp ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT comp, period, i, n, seen, coalesce(v, a + (c - a) / nullif(ic - ia, 0) * (i - ia), a, c) AS v FROM z)
SELECT comp, period,
       round(CASE WHEN seen > 0 OR n < 3 THEN v
                  WHEN i = 1 THEN (v + lead(v, 1) OVER w + lead(v, 2) OVER w) / 3
                  WHEN i = 2 THEN (v + lag(v, 1) OVER w + v) / 3
                  ELSE (lag(v, 2) OVER w + lag(v, 1) OVER w + v) / 3 END, 4) AS error
FROM l WINDOW w AS (PARTITION BY comp ORDER BY period)""",
    ),
)
def q_fill_linear_blend(spark, sf_dir):
    blended = f.attach_blend(panel_event(spark, sf_dir), SPEC, ["error"])
    out = f.fill_linear_or(blended, SPEC, "error", blend_col="__blend_error")
    return out.select(*KEYS, F.round("error", 4).alias("error"))


@query(
    "q_fill_approx",
    with_panels(
        EVENT,
        body="""
, own AS (SELECT comp, regr_slope(purchase, click) AS b, regr_intercept(purchase, click) AS a,
                 avg(CASE WHEN click IS NOT NULL THEN purchase END) AS m, count(CASE WHEN purchase IS NOT NULL AND click IS NOT NULL THEN 1 END) AS n
          FROM panel_event GROUP BY 1),
span AS (SELECT comp, industry, min(period) AS lo, max(period) AS hi FROM panel_event GROUP BY 1, 2),
need AS (SELECT span.* FROM span JOIN own ON span.comp = own.comp WHERE own.n = 0),
grp AS (SELECT need.comp, regr_slope(e.purchase, e.click) AS b, regr_intercept(e.purchase, e.click) AS a, avg(CASE WHEN e.click IS NOT NULL THEN e.purchase END) AS m
        FROM need JOIN panel_event e ON e.industry = need.industry AND e.period BETWEEN need.lo AND need.hi GROUP BY 1)
SELECT e.comp, e.period,
       round(coalesce(e.purchase, CASE WHEN own.n > 0 THEN CASE WHEN own.a IS NULL AND e.click IS NOT NULL THEN own.m ELSE own.a + own.b * e.click END
                                 ELSE CASE WHEN grp.a IS NULL AND e.click IS NOT NULL THEN grp.m ELSE grp.a + grp.b * e.click END END), 3) AS purchase
FROM panel_event e JOIN own ON e.comp = own.comp LEFT JOIN grp ON e.comp = grp.comp""",
    ),
)
def q_fill_approx(spark, sf_dir):
    panel = cut_lineage(panel_event(spark, sf_dir).select(*KEYS, "industry", "purchase", "click"))
    out = f.fill_approx(panel, SPEC, "purchase", ["click"])
    return out.select(*KEYS, F.round("purchase", 3).alias("purchase"))


@query(
    "q_fill_approx_multi",
    with_panels(
        SUPPLIER,
        body="""
, c AS (SELECT * FROM panel_supplier WHERE orderbacklog IS NOT NULL),
mo AS (SELECT comp, count(*) AS n, covar_pop(inventory, orderbacklog) AS c1, covar_pop(grossmargin, orderbacklog) AS c2, covar_pop(inventory, grossmargin) AS c12,
              var_pop(inventory) AS v1, var_pop(grossmargin) AS v2, avg(inventory) AS m1, avg(grossmargin) AS m2, avg(orderbacklog) AS my FROM c GROUP BY 1),
b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM mo WHERE n > 2)
SELECT p.comp, p.period, round(coalesce(p.orderbacklog, my + b1 * (p.inventory - m1) + b2 * (p.grossmargin - m2)), 4) AS orderbacklog
FROM panel_supplier p JOIN b ON p.comp = b.comp""",
    ),
)
def q_fill_approx_multi(spark, sf_dir):
    """Two regressors; every supplier has rows enough for a unique fit."""
    panel = cut_lineage(panel_supplier(spark, sf_dir).select(*KEYS, "industry", "orderbacklog", "inventory", "grossmargin"))
    out = f.fill_approx(panel, SPEC, "orderbacklog", ["inventory", "grossmargin"])
    return out.select(*KEYS, F.round("orderbacklog", 4).alias("orderbacklog"))


@query(
    "q_fill_rules",
    with_panels(
        EVENT,
        body="""
, p1 AS (SELECT comp, period, coalesce(purchase, click + viewed) AS purchase, click, viewed, error FROM panel_event),
p2 AS (SELECT comp, period, purchase, coalesce(click, purchase - viewed) AS click, viewed, error FROM p1),
p3 AS (SELECT comp, period, coalesce(purchase, click + viewed) AS purchase, click, viewed, error FROM p2),
r AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY period) AS i FROM p3),
n AS (SELECT *, last_value(viewed IGNORE NULLS) OVER b AS a, last_value(CASE WHEN viewed IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia,
             first_value(viewed IGNORE NULLS) OVER f AS z, first_value(CASE WHEN viewed IS NOT NULL THEN i END IGNORE NULLS) OVER f AS iz
      FROM r WINDOW b AS (PARTITION BY comp ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    f AS (PARTITION BY comp ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT comp, period, purchase, click, coalesce(viewed, a + (z - a) / nullif(iz - ia, 0) * (i - ia), a, z, 0) AS viewed, coalesce(error, 0) AS error FROM n),
w1 AS (SELECT comp, period, coalesce(purchase, click + viewed) AS purchase, click, viewed, error FROM v)
SELECT comp, period, round(purchase, 4) AS purchase, round(coalesce(click, purchase - viewed), 4) AS click, round(viewed, 4) AS viewed, error FROM w1""",
    ),
)
def q_fill_rules(spark, sf_dir):
    """Rule orchestration: formula passes, then every rule twice in catalogue order."""
    p = panel_event(spark, sf_dir).select(*KEYS, "industry", *EVENT_MEASURES)
    rules = {
        "purchase": parse_rules(["formula:click+viewed"]),
        "click": parse_rules(["formula:purchase-viewed"]),
        "viewed": parse_rules(["method:linear(or=0)"]),
        "error": parse_rules(["value:0"]),
    }
    out = f.apply_rules(p, SPEC, rules, annual_aware=False)
    return out.select(*KEYS, *[F.round(c, 4).alias(c) for c in ("purchase", "click", "viewed")], "error")


@query(
    "q_forecast_missing",
    with_panels(
        CUSTOMER,
        body="""
, l AS (SELECT comp, period, sales, lag(sales) OVER (PARTITION BY comp ORDER BY period) AS l1 FROM panel_customer),
f AS (SELECT comp, regr_slope(sales, l1) AS b, regr_intercept(sales, l1) AS a, count(CASE WHEN sales IS NOT NULL AND l1 IS NOT NULL THEN 1 END) AS n
      FROM l GROUP BY 1)
SELECT l.comp, l.period, round(CASE WHEN n > 2 THEN a + b * sales END, 1) AS est_1, round(CASE WHEN n > 2 THEN a + b * (a + b * sales) END, 1) AS est_2
FROM l JOIN f ON l.comp = f.comp""",
    ),
)
def q_forecast_missing(spark, sf_dir):
    p = panel_customer(spark, sf_dir).select(*KEYS, "sales", F.lit(None).cast("double").alias("est_1"), F.lit(None).cast("double").alias("est_2"))
    out = f.forecast_missing(p, SPEC, "sales", ["est_1", "est_2"])
    return out.select(*KEYS, F.round("est_1", 1).alias("est_1"), F.round("est_2", 1).alias("est_2"))


@query(
    "q_clean_panel",
    with_panels(
        EVENT,
        body=f"""
, c AS (SELECT *, {FILLED} AS filled FROM panel_event),
r AS (SELECT *, CAST(filled AS DOUBLE) / (SELECT max(filled) FROM c) AS data_quality FROM c),
k AS (SELECT * FROM r WHERE viewed IS NOT NULL AND data_quality >= 0.5),
x AS (SELECT comp, period, coalesce(purchase, 0) AS purchase, coalesce(click, viewed - error) AS click, data_quality FROM k)
SELECT comp, period, purchase, click, data_quality FROM x WHERE click IS NOT NULL""",
    ),
)
def q_clean_panel(spark, sf_dir):
    """Cleaning end to end: infinities, required columns, fill-rate cut, rules, required columns again."""
    from panelweave.plans.clean import clean_panel

    cleaned, _ = clean_panel(
        panel_event(spark, sf_dir).select(*KEYS, "industry", *EVENT_MEASURES),
        SPEC,
        {"purchase": parse_rules(["value:0"]), "click": parse_rules(["formula:viewed-error"])},
        required_before=["viewed"],
        required_after=["click"],
        row_pct=0.5,
        score_cols=EVENT_MEASURES,
        annual_aware=False,
        checkpoint=False,
    )
    return cleaned.select(*KEYS, "purchase", "click", "data_quality")


@query(
    "q_fill_effect",
    with_panels(
        CUSTOMER,
        body=FILL_LINEAR_SQL
        + """
, filled AS (SELECT comp, period, coalesce(sales, a + (z - a) / nullif(iz - ia, 0) * (i - ia), a, z) AS sales FROM n),
d AS (SELECT comp, period, coalesce(sales / nullif(lag(sales) OVER w, 0) - 1, 0) AS p FROM filled WINDOW w AS (PARTITION BY comp ORDER BY period))
SELECT period, count(*) AS n, round(avg(p), 6) AS mean_change FROM d GROUP BY 1""",
    ),
)
def q_fill_effect(spark, sf_dir):
    """Fill, change and average in one plan: one shuffle by entity, then a small aggregate."""
    filled = f.fill_linear(panel_customer(spark, sf_dir), SPEC, ["sales"])
    changed = pct_change(filled, SPEC, ["sales"])
    return changed.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_sales"), 6).alias("mean_change"))


@query("q_required_after", with_panels(CUSTOMER, body="SELECT comp, period, coalesce(sales, n_orders * 2) AS sales FROM panel_customer WHERE coalesce(sales, n_orders * 2) IS NOT NULL"))
def q_required_after(spark, sf_dir):
    p = panel_customer(spark, sf_dir).select(*KEYS, "sales", F.col("n_orders").cast("double").alias("n_orders"))
    return qual.require_columns(f.fill_formula(p, "sales", "n_orders*2"), ["sales"]).select(*KEYS, "sales")
