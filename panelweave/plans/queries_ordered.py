"""Queries over the ordered rows of each entity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.operators import ordered as o
from panelweave.operators.fill import attach_blend, empty_series_values
from panelweave.plans.panel_sql import CUSTOMER, EVENT, SUPPLIER, with_panels
from panelweave.plans.registry import query
from panelweave.plans.views import SPEC, load, panel_customer, panel_event, panel_supplier
from panelweave.spec import q

KEYS = ["comp", "period"]


@query(
    "q_lag",
    with_panels(
        SUPPLIER,
        body="""
SELECT comp, period, lag(sales, 1) OVER w AS sales_sft_1, lag(employeenum, 1) OVER w AS employeenum_sft_1,
       lag(orderbacklog, 1) OVER w AS orderbacklog_sft_1
FROM panel_supplier WINDOW w AS (PARTITION BY comp ORDER BY period)""",
    ),
)
def q_lag(spark, sf_dir):
    cols = ["sales", "employeenum", "orderbacklog"]
    return o.lag_columns(panel_supplier(spark, sf_dir), SPEC, cols, 1).select(*KEYS, *[f"{c}_sft_1" for c in cols])


@query(
    "q_lag_set",
    with_panels(
        SUPPLIER,
        body="""
SELECT comp, period, lag(sales, 2) OVER w AS sales_sft_2, lag(sales, 4) OVER w AS sales_sft_4,
       lag(inventory, 2) OVER w AS inventory_sft_2, lag(inventory, 4) OVER w AS inventory_sft_4,
       lag(netincome, 1) OVER w AS netincome_sft_1
FROM panel_supplier WINDOW w AS (PARTITION BY comp ORDER BY period)""",
    ),
)
def q_lag_set(spark, sf_dir):
    p = panel_supplier(spark, sf_dir).select(*KEYS, "sales", "inventory", "netincome", "randd")
    out = o.lag_set(p, SPEC, {"__all__": [2, 4], "netincome": [1]}, exclude=["randd"])
    return out.drop("sales", "inventory", "netincome", "randd")


@query(
    "q_lag_backfill",
    with_panels(
        SUPPLIER,
        body="""
, l AS (SELECT comp, period, lag(sales) OVER w AS a, lag(orderbacklog) OVER w AS b
        FROM panel_supplier WINDOW w AS (PARTITION BY comp ORDER BY period))
SELECT comp, period,
       first_value(a IGNORE NULLS) OVER f AS sales_sft_1, first_value(b IGNORE NULLS) OVER f AS orderbacklog_sft_1
FROM l WINDOW f AS (PARTITION BY comp ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    ),
)
def q_lag_backfill(spark, sf_dir):
    out = o.lag_backfill(panel_supplier(spark, sf_dir), SPEC, ["sales", "orderbacklog"], 1)
    return out.select(*KEYS, "sales_sft_1", "orderbacklog_sft_1")


@query(
    "q_shift_fill",
    with_panels(
        SUPPLIER,
        body="""
SELECT comp, period, lag(sales, 2, 0) OVER w AS back, lead(sales, 3) OVER w AS ahead
FROM panel_supplier WINDOW w AS (PARTITION BY comp ORDER BY period)""",
    ),
)
def q_shift_fill(spark, sf_dir):
    p = panel_supplier(spark, sf_dir)
    return o.shift_fill(o.shift_fill(p, SPEC, "sales", 2, 0.0, "back"), SPEC, "sales", -3, None, "ahead").select(*KEYS, "back", "ahead")


@query(
    "q_pct_change",
    with_panels(
        CUSTOMER,
        body="""
, v AS (SELECT comp, period,
               last_value(sales IGNORE NULLS) OVER w AS a, last_value(urgent_avg IGNORE NULLS) OVER w AS b
        FROM panel_customer
        WINDOW w AS (PARTITION BY comp ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT comp, period, coalesce(a / nullif(lag(a) OVER w, 0) - 1, 0) AS p_sales,
       coalesce(b / nullif(lag(b) OVER w, 0) - 1, 0) AS p_urgent_avg
FROM v WINDOW w AS (PARTITION BY comp ORDER BY period)""",
    ),
)
def q_pct_change(spark, sf_dir):
    return o.pct_change(panel_customer(spark, sf_dir), SPEC, ["sales", "urgent_avg"]).select(*KEYS, "p_sales", "p_urgent_avg")


@query(
    "q_nan_runs",
    with_panels(
        CUSTOMER,
        body="""
, r AS (SELECT comp, sales, row_number() OVER (PARTITION BY comp ORDER BY period) - 1 AS i,
               count(*) OVER (PARTITION BY comp) AS n FROM panel_customer),
g AS (SELECT comp, i, n, i - row_number() OVER (PARTITION BY comp ORDER BY i) AS grp FROM r WHERE sales IS NULL),
b AS (SELECT comp, grp, min(i) AS run_start, max(i) AS run_end, max(n) AS n FROM g GROUP BY 1, 2),
e AS (SELECT *, coalesce(lag(run_end) OVER w, -1) + 1 AS lo, coalesce(lead(run_start) OVER w, n) AS hi
      FROM b WINDOW w AS (PARTITION BY comp ORDER BY run_start))
SELECT comp, run_start, run_end,
       CASE WHEN (hi - lo) - (run_end - run_start + 1) = 0 THEN 'nothing' WHEN run_start = 0 THEN 'start'
            WHEN run_end = n - 1 THEN 'end' ELSE 'mid' END AS run_case,
       (hi - lo) - (run_end - run_start + 1) AS n_filled, run_end - run_start + 1 AS n_null
FROM e""",
    ),
)
def q_nan_runs(spark, sf_dir):
    return o.missing_runs(panel_customer(spark, sf_dir), SPEC, "sales")


FILL_LINEAR_SQL = """
, r AS (SELECT comp, period, sales, row_number() OVER (PARTITION BY comp ORDER BY period) AS i FROM panel_customer),
n AS (SELECT *, last_value(sales IGNORE NULLS) OVER b AS a,
             last_value(CASE WHEN sales IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia,
             first_value(sales IGNORE NULLS) OVER f AS z,
             first_value(CASE WHEN sales IS NOT NULL THEN i END IGNORE NULLS) OVER f AS iz
      FROM r
      WINDOW b AS (PARTITION BY comp ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY comp ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@query(
    "q_fill_linear",
    with_panels(
        CUSTOMER,
        body=FILL_LINEAR_SQL + "SELECT comp, period, coalesce(sales, a + (z - a) / nullif(iz - ia, 0) * (i - ia), a, z) AS sales FROM n",
    ),
)
def q_fill_linear(spark, sf_dir):
    return o.fill_linear(panel_customer(spark, sf_dir), SPEC, ["sales"]).select(*KEYS, "sales")


@query(
    "q_rolling_mean",
    with_panels(
        SUPPLIER,
        body="""
SELECT comp, period, round(avg(sales) OVER (PARTITION BY comp ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 3) AS sales_avg_4
FROM panel_supplier""",
    ),
)
def q_rolling_mean(spark, sf_dir):
    out = o.rolling_mean(panel_supplier(spark, sf_dir), SPEC, "sales", 4, "sales_avg_4")
    return out.select(*KEYS, F.round("sales_avg_4", 3).alias("sales_avg_4"))


SMOOTH_SQL = """
, r AS (SELECT comp, inventory AS v, row_number() OVER (PARTITION BY comp ORDER BY period) - 1 AS i,
               count(*) OVER (PARTITION BY comp) AS n FROM panel_supplier),
c AS (SELECT DISTINCT comp, n FROM r),
k(k, w) AS (VALUES {weights}),
j AS (SELECT comp, n, unnest(generate_series(0, n + {reach} - 1)) AS position FROM c WHERE n > {reach}),
m AS (SELECT j.comp, j.position, k.w, j.n, j.position + {reach} - k.k AS m FROM j CROSS JOIN k),
x AS (SELECT comp, position, w,
             CASE WHEN m < {reach} THEN {reach} - m WHEN m < {reach} + n THEN m - {reach} ELSE n - 1 - (m - {reach} - n) END AS i FROM m)
SELECT x.comp, x.position, round(sum(x.w * r.v), 6) AS smoothed FROM x JOIN r ON x.comp = r.comp AND x.i = r.i
GROUP BY x.comp, x.position
"""


def _weights(*w: float) -> str:
    return ", ".join(f"({i}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(w))


def _smooth_sql(*w: float) -> str:
    return with_panels(SUPPLIER, body=SMOOTH_SQL.format(weights=_weights(*w), reach=len(w) - 1))


@query("q_smooth_flat", _smooth_sql(1 / 3, 1 / 3, 1 / 3))
def q_smooth_flat(spark, sf_dir):
    out = o.smooth(panel_supplier(spark, sf_dir), SPEC, "inventory", 3, "flat")
    return out.withColumn("smoothed", F.round("smoothed", 6))


@query("q_smooth_hanning", _smooth_sql(0.0, 0.25, 0.5, 0.25, 0.0))
def q_smooth_hanning(spark, sf_dir):
    out = o.smooth(panel_supplier(spark, sf_dir), SPEC, "inventory", 5, "hanning")
    return out.withColumn("smoothed", F.round("smoothed", 6))


EMPTY_SERIES_SQL = """
, g AS (SELECT industry, period, count(*) AS n_rows, count(error) AS ng, avg(error) AS mg, stddev_samp(error) AS sg
        FROM panel_event GROUP BY 1, 2),
p AS (SELECT period, avg(error) AS mp, stddev_samp(error) AS sp FROM panel_event GROUP BY 1),
s AS (SELECT g.industry, g.period, mg, mp,
             least(1.0, CAST(ng AS DOUBLE) / 10 * (CAST(ng AS DOUBLE) / nullif(n_rows, 0))) / 3
             + (1 - 1 / (1 + exp(-((sg / nullif(mg, 0)) / nullif(sp / nullif(mp, 0), 0) - 1)))) * 2 / 3 AS score
      FROM g JOIN p ON g.period = p.period),
blend AS (SELECT industry, period, coalesce(mg * score + mp * (1 - score), mg, mp) AS blend FROM s)
"""


@query(
    "q_fill_empty_series",
    with_panels(
        EVENT,
        body=EMPTY_SERIES_SQL
        + """
, x AS (SELECT e.comp, e.period, b.blend, row_number() OVER w AS i, count(*) OVER (PARTITION BY e.comp) AS n,
               avg(blend) OVER (PARTITION BY e.comp) AS m, stddev_samp(blend) OVER (PARTITION BY e.comp) AS sd
        FROM panel_event e JOIN blend b ON e.industry = b.industry AND e.period = b.period
        WINDOW w AS (PARTITION BY e.comp ORDER BY e.period)),
y AS (SELECT comp, period, i, n, CASE WHEN abs((blend - m) / nullif(sd, 0)) > 0.75 THEN NULL ELSE blend END AS v FROM x),
z AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia,
             first_value(v IGNORE NULLS) OVER f AS c, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ic
      FROM y WINDOW b AS (PARTITION BY comp ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    f AS (PARTITION BY comp ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT comp, period, i, n, coalesce(v, a + (c - a) / nullif(ic - ia, 0) * (i - ia), a, c) AS v FROM z)
SELECT comp, period,
       round(CASE WHEN n < 3 THEN v
                  WHEN i = 1 THEN (v + lead(v, 1) OVER w + lead(v, 2) OVER w) / 3
                  WHEN i = 2 THEN (v + lag(v, 1) OVER w + v) / 3
                  ELSE (lag(v, 2) OVER w + lag(v, 1) OVER w + v) / 3 END, 4) AS fill_value
FROM l WINDOW w AS (PARTITION BY comp ORDER BY period)""",
    ),
)
def q_fill_empty_series(spark, sf_dir):
    blended = attach_blend(panel_event(spark, sf_dir), SPEC, ["error"])
    out = empty_series_values(blended, SPEC, "__blend_error", "fill_value")
    return out.select(*KEYS, F.round("fill_value", 4).alias("fill_value"))


def panel_annual(spark, sf_dir):
    """Customer panel whose measure is the yearly total repeated on its quarters, with the last two order-free.

    The total is a window within the customer's rows, so it needs no join of the panel with itself.
    """
    p = panel_customer(spark, sf_dir).filter(F.col("comp").isNotNull())
    yearly = F.sum("sales").over(Window.partitionBy("comp", "data_year"))
    return p.select("comp", "period", "data_year", "data_qrt", yearly.alias("yearly"))


ANNUAL_SQL = """
, y AS (SELECT comp, data_year, sum(sales) AS yearly FROM panel_customer GROUP BY 1, 2),
a AS (SELECT p.comp, p.period, y.yearly AS v FROM panel_customer p JOIN y ON p.comp = y.comp AND p.data_year = y.data_year),
s AS (SELECT *, lag(v) OVER w AS pv, lead(v, 4) OVER w AS v4, lead(v, 3) OVER w AS v3,
             row_number() OVER w AS i, count(*) OVER (PARTITION BY comp) AS n
      FROM a WINDOW w AS (PARTITION BY comp ORDER BY period)),
f AS (SELECT comp, period, i, n, v, pv,
             coalesce(i > 1 AND abs(pv - v) < 0.001, false) AS eq,
             coalesce(i > 1 AND abs(v3 - v4) < 0.001 AND abs(v3 - v) > 0.001, false) AS st FROM s),
t AS (SELECT *, i - coalesce(max(CASE WHEN NOT eq THEN i END) OVER w, 0) AS e,
             i - coalesce(max(CASE WHEN NOT st THEN i END) OVER w, 0) AS c
      FROM f WINDOW w AS (PARTITION BY comp ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
flag AS (SELECT comp, bool_or(i + 4 <= n AND ((c = 3 AND e > 1) OR (c > 1 AND e = 3) OR e + c >= 4)) AS annual FROM t GROUP BY comp),
o AS (SELECT comp, coalesce(min(CASE WHEN i > 1 AND (abs(pv - v) > 0.001 OR (pv IS NULL) <> (v IS NULL)) THEN i - 1 END) % 4, 0) AS off
      FROM f GROUP BY comp),
grp AS (SELECT f.comp, f.period, f.i, f.v, (f.i - 1 - o.off + CASE WHEN o.off > 0 THEN 4 ELSE 0 END) // 4 AS g
        FROM f JOIN o ON f.comp = o.comp)
"""


@query("q_annual_flag", with_panels(CUSTOMER, body=ANNUAL_SQL + "SELECT comp, annual FROM flag"))
def q_annual_flag(spark, sf_dir):
    return o.annual_flag(panel_annual(spark, sf_dir), SPEC, "yearly")


@query("q_annual_groups", with_panels(CUSTOMER, body=ANNUAL_SQL + "SELECT comp, period, g AS year_group FROM grp"))
def q_annual_groups(spark, sf_dir):
    return o.annual_groups(panel_annual(spark, sf_dir), SPEC, "yearly").select(*KEYS, "year_group")


@query(
    "q_fill_annual",
    with_panels(
        CUSTOMER,
        body=ANNUAL_SQL
        + """
, h AS (SELECT comp, g, first(v ORDER BY period) AS own FROM grp GROUP BY 1, 2),
hn AS (SELECT *, last_value(own IGNORE NULLS) OVER b AS a, last_value(CASE WHEN own IS NOT NULL THEN g END IGNORE NULLS) OVER b AS ga,
              first_value(own IGNORE NULLS) OVER f AS z, first_value(CASE WHEN own IS NOT NULL THEN g END IGNORE NULLS) OVER f AS gz
       FROM h WINDOW b AS (PARTITION BY comp ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     f AS (PARTITION BY comp ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
hg AS (SELECT comp, bool_or(own IS NULL) AS gap FROM h GROUP BY comp),
ln AS (SELECT comp, period, g, i, v, last_value(v IGNORE NULLS) OVER b AS a, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia,
              first_value(v IGNORE NULLS) OVER f AS z, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS iz
       FROM grp WINDOW b AS (PARTITION BY comp ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                       f AS (PARTITION BY comp ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ln.comp, ln.period,
       round(CASE WHEN flag.annual AND hg.gap
            THEN coalesce(ln.v, CASE WHEN hn.own IS NULL THEN coalesce(hn.a + (hn.z - hn.a) / nullif(hn.gz - hn.ga, 0) * (hn.g - hn.ga), hn.a, hn.z) END)
            ELSE coalesce(ln.v, ln.a + (ln.z - ln.a) / nullif(ln.iz - ln.ia, 0) * (ln.i - ln.ia), ln.a, ln.z) END, 4) AS yearly
FROM ln JOIN hn ON ln.comp = hn.comp AND ln.g = hn.g JOIN hg ON ln.comp = hg.comp JOIN flag ON ln.comp = flag.comp""",
    ),
)
def q_fill_annual(spark, sf_dir):
    out = o.fill_annual_aware(panel_annual(spark, sf_dir), SPEC, "yearly")
    return out.select(*KEYS, F.round("yearly", 4).alias("yearly"))


@query(
    "q_seasonality",
    with_panels(
        SUPPLIER,
        body="""
SELECT comp, period, CAST(round(sin((data_qrt - 1) * pi() / 2)) AS BIGINT) AS t_qrt_sin,
       CAST(round(cos((data_qrt - 1) * pi() / 2)) AS BIGINT) AS t_qrt_cos FROM panel_supplier""",
    ),
)
def q_seasonality(spark, sf_dir):
    return o.season(panel_supplier(spark, sf_dir), "data_qrt").select(*KEYS, "t_qrt_sin", "t_qrt_cos")


@query("q_distinct_keys", "SELECT DISTINCT l_suppkey AS comp, CAST(year(l_shipdate) AS BIGINT) AS data_year FROM lineitem")
def q_distinct_keys(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(q("l_suppkey").alias("comp"), F.year("l_shipdate").cast("bigint").alias("data_year"))
    return o.distinct_values(li, ["comp", "data_year"])
