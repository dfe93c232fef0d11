"""Queries for the named feature sets and the whole feature frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators.link import join_many_to_one, merge_all
from panelweave.operators.ordered import lag_backfill, pct_change
from panelweave.plans import features as fe
from panelweave.plans.panel_sql import RATIOS, SUPPLIER, with_panels
from panelweave.plans.registry import query
from panelweave.plans.views import SECTOR_SPEC, SPEC, panel_supplier, panel_supplier_ratios
from panelweave.spec import q

KEYS = ["comp", "period"]
DIGITS = 6


def _ident(name: str) -> str:
    return '"' + name + '"'


def _changes(cols) -> str:
    """Percent changes of ``cols`` as CTE ``chg`` over ``base``."""
    carried = ", ".join(f'last_value({c} IGNORE NULLS) OVER b AS "v_{c}"' for c in cols)
    made = ", ".join(f'coalesce("v_{c}" / nullif(lag("v_{c}") OVER w, 0) - 1, 0) AS "p_{c}"' for c in cols)
    return f"""
, car AS (SELECT *, {carried} FROM base WINDOW b AS (PARTITION BY comp ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
chg AS (SELECT *, {made} FROM car WINDOW w AS (PARTITION BY comp ORDER BY period))"""


LEVI_BASE = """
, gm AS (SELECT sector, period, avg(capitalexpenditures) AS capitalexpenditures_avg, avg(randd) AS randd_avg FROM panel_ratios GROUP BY 1, 2),
j AS (SELECT p.*, gm.capitalexpenditures_avg, gm.randd_avg FROM panel_ratios p LEFT JOIN gm ON p.sector = gm.sector AND p.period = gm.period),
lg AS (SELECT *, lag(sales) OVER w AS ls, lag(employeenum) OVER w AS le, lag(dividendperstock) OVER w AS ld FROM j WINDOW w AS (PARTITION BY comp ORDER BY period)),
base AS (SELECT *, first_value(ls IGNORE NULLS) OVER f AS sales_sft_1, first_value(le IGNORE NULLS) OVER f AS employeenum_sft_1,
                first_value(ld IGNORE NULLS) OVER f AS dividendperstock_sft_1
         FROM lg WINDOW f AS (PARTITION BY comp ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

LEVI_SQL = {
    "1_Inventory": "p_inventory - p_sales",
    "3_CAPX": "p_capitalexpenditures_avg - p_capitalexpenditures",
    "4_RnD": "p_randd_avg - p_randd",
    "5_Gross Margin": "p_sales - p_grossmargin",
    "6_Sales & Admin. Exp.": "p_sga - p_sales",
    "9_Order Backlog": "p_sales - p_orderbacklog",
    "10_Labor Force": "((sales_sft_1 / nullif(employeenum_sft_1, 0)) - (sales / nullif(employeenum, 0))) / nullif(sales_sft_1, 0) / nullif(employeenum_sft_1, 0)",
    "11_FIFO/LIFO dummy": "CASE WHEN fifovslifo < 0 THEN 1 ELSE 0 END",
}
OU_SQL = {
    **{name: f"p_{m}" for name, m in fe.OU_CHANGES.items()},
    **{name: m for name, m in fe.OU_LEVELS.items()},
    "14_div per share": "dividendperstock - dividendperstock_sft_1",
    "20_CAPEX To Assets last year": "p_capextoassets_sft_4",
}
XUE_SQL = {
    **{name: f"p_{m}" for name, m in fe.XUE_CHANGES.items()},
    **{name: m for name, m in fe.XUE_LEVELS.items()},
    "4_CF to Assets": "leveredfocf / nullif(totalassets, 0)",
}
TARGET_SQL = {k: v for name, m in fe.TARGETS.items() for k, v in ((name, m), (f"{name} pct", f"p_{m}"))}
FLAGS = ("11_FIFO/LIFO dummy",)

OU_LAG = """
, l4 AS (SELECT *, lag(p_capextoassets, 4) OVER w AS l4 FROM chg WINDOW w AS (PARTITION BY comp ORDER BY period)),
ready AS (SELECT *, first_value(l4 IGNORE NULLS) OVER f AS p_capextoassets_sft_4 FROM l4
          WINDOW f AS (PARTITION BY comp ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _list(exprs: dict, rounded: bool = True) -> str:
    return ", ".join(f"round({e}, {DIGITS}) AS {_ident(n)}" if rounded and n not in FLAGS else f"{e} AS {_ident(n)}" for n, e in exprs.items())


def _rounded(df, names):
    return df.select(*[q(k) for k in df.columns if k not in names], *[F.round(q(n), DIGITS).alias(n) if n not in FLAGS else q(n) for n in names])


@query(
    "q_features_lev_thi",
    with_panels(
        RATIOS,
        body=LEVI_BASE + _changes([*fe.LEVI_CHANGES, "capitalexpenditures_avg", "randd_avg"]) + f" SELECT comp, period, {_list(LEVI_SQL)} FROM chg",
    ),
)
def q_features_lev_thi(spark, sf_dir):
    return _rounded(fe.lev_thi(panel_supplier_ratios(spark, sf_dir), SECTOR_SPEC), list(LEVI_SQL))


@query(
    "q_features_ou_penn",
    with_panels(RATIOS, body=LEVI_BASE + _changes(list(fe.OU_CHANGES.values())) + OU_LAG + f" SELECT comp, period, {_list(OU_SQL)} FROM ready"),
)
def q_features_ou_penn(spark, sf_dir):
    return _rounded(fe.ou_penn(panel_supplier_ratios(spark, sf_dir), SECTOR_SPEC), list(OU_SQL))


XUE_IN = ", ".join(f'{e} AS {_ident("in_" + n)}' for n, e in XUE_SQL.items())
XUE_MEAN = ", ".join(f'avg({_ident("in_" + n)}) AS {_ident("m_" + n)}' for n in XUE_SQL)
XUE_CMP = ", ".join(f'CAST(coalesce({_ident("in_" + n)} >= {_ident("m_" + n)}, false) AS BIGINT) AS {_ident(n)}' for n in XUE_SQL)


@query(
    "q_features_xue_zha",
    with_panels(
        RATIOS,
        body=", base AS (SELECT * FROM panel_ratios)"
        + _changes(list(fe.XUE_CHANGES.values()))
        + f", x AS (SELECT comp, sector, period, {XUE_IN} FROM chg), m AS (SELECT sector, period, {XUE_MEAN} FROM x GROUP BY 1, 2)"
        + f" SELECT x.comp, x.period, {XUE_CMP} FROM x JOIN m ON x.sector = m.sector AND x.period = m.period",
    ),
)
def q_features_xue_zha(spark, sf_dir):
    return fe.xue_zha(panel_supplier_ratios(spark, sf_dir), SECTOR_SPEC)


@query(
    "q_features_targets",
    with_panels(RATIOS, body=", base AS (SELECT * FROM panel_ratios)" + _changes(list(fe.TARGETS.values())) + f" SELECT comp, period, {_list(TARGET_SQL)} FROM chg"),
)
def q_features_targets(spark, sf_dir):
    return _rounded(fe.targets(panel_supplier_ratios(spark, sf_dir), SECTOR_SPEC), list(TARGET_SQL))


FULL = {**LEVI_SQL, **OU_SQL, **TARGET_SQL}
FULL_CHANGES = list(dict.fromkeys([*fe.LEVI_CHANGES, "capitalexpenditures_avg", "randd_avg", *fe.OU_CHANGES.values(), *fe.XUE_CHANGES.values(), *fe.TARGETS.values()]))
FULL_LIST = ", ".join(f"coalesce({e}, 0) AS {_ident(n)}" if n in FLAGS else f"round(coalesce({e}, 0), {DIGITS}) AS {_ident(n)}" for n, e in FULL.items())
FULL_NAMES = ", ".join(f"x.{_ident(n)}" for n in FULL)
SEASON_SQL = "CAST(round(sin((data_qrt - 1) * pi() / 2)) AS BIGINT) AS t_qrt_sin, CAST(round(cos((data_qrt - 1) * pi() / 2)) AS BIGINT) AS t_qrt_cos"


@query(
    "q_features_full",
    with_panels(
        RATIOS,
        body=LEVI_BASE
        + _changes(FULL_CHANGES)
        + OU_LAG
        + f", x AS (SELECT comp, sector, period, p_eps, {SEASON_SQL}, {FULL_LIST}, {XUE_IN} FROM ready), m AS (SELECT sector, period, {XUE_MEAN} FROM x GROUP BY 1, 2)"
        + f" SELECT x.comp, x.period, x.t_qrt_sin, x.t_qrt_cos, {FULL_NAMES}, {XUE_CMP} FROM x JOIN m ON x.sector = m.sector AND x.period = m.period WHERE p_eps > -3 AND p_eps < 3",
    ),
)
def q_features_full(spark, sf_dir):
    """All sets and targets as one frame."""
    out = fe.build_features(panel_supplier_ratios(spark, sf_dir), SECTOR_SPEC, quarter="data_qrt", materialise=True)
    return _rounded(out, list(FULL))


@query(
    "q_features_lagged",
    with_panels(
        RATIOS,
        body=LEVI_BASE
        + _changes([*fe.LEVI_CHANGES, "capitalexpenditures_avg", "randd_avg", *fe.TARGETS.values()])
        + """, x AS (SELECT comp, period, p_eps, "p_sga" - p_sales AS s, eps AS y FROM chg),
l AS (SELECT *, coalesce(lag(s, 2) OVER w, 0) AS s2, coalesce(lag(s, 4) OVER w, 0) AS s4, coalesce(lag(y, 2) OVER w, 0) AS y2 FROM x WINDOW w AS (PARTITION BY comp ORDER BY period))
SELECT comp, period, round(s, 6) AS s, round(s2, 6) AS s2, round(s4, 6) AS s4, round(y2, 6) AS y2 FROM l WHERE p_eps > -3 AND p_eps < 3""",
    ),
)
def q_features_lagged(spark, sf_dir):
    """The frame with lags 2 and 4 of every feature and target; three of them are shown."""
    out = fe.build_features(panel_supplier_ratios(spark, sf_dir), SECTOR_SPEC, sets=["lev_thi"], with_lags=True)
    name = "6_Sales & Admin. Exp."
    picks = {"s": name, "s2": f"{name}_sft_2", "s4": f"{name}_sft_4", "y2": "y_eps_sft_2"}
    return out.select(*KEYS, *[F.round(q(c), 6).alias(n) for n, c in picks.items()])


@query(
    "q_features_yearly",
    with_panels(
        RATIOS,
        body="""
, l AS (SELECT *, lag(eps) OVER (PARTITION BY comp ORDER BY period) AS lg FROM panel_ratios),
s AS (SELECT comp, data_qrt, stddev_samp(lg) AS sd FROM l GROUP BY 1, 2),
b AS (SELECT comp, data_qrt FROM s WHERE sd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY comp ORDER BY sd DESC, data_qrt DESC) = 1),
base AS (SELECT l.comp, l.sector, l.data_year * 100 AS period, l.eps, l.sales, l.inventory FROM l JOIN b ON l.comp = b.comp AND l.data_qrt = b.data_qrt)"""
        + _changes(["eps", "sales", "inventory"])
        + ' SELECT comp, period, round(p_inventory - p_sales, 6) AS "1_Inventory", round(eps, 6) AS y_eps, round(p_eps, 6) AS "y_eps pct" FROM chg WHERE p_eps > -3 AND p_eps < 3',
    ),
)
def q_features_yearly(spark, sf_dir):
    """Quarterly panel reduced to one row per year before the features are built."""
    out = fe.build_features(panel_supplier_ratios(spark, sf_dir), SECTOR_SPEC, sets=["lev_thi"], yearly=True)
    return out.select(*KEYS, *[F.round(q(c), 6).alias(c) for c in ("1_Inventory", "y_eps", "y_eps pct")])


@query(
    "q_merge_features",
    with_panels(
        SUPPLIER,
        body="""
, a AS (SELECT comp, period, coalesce(sales / nullif(lag(sales) OVER w, 0) - 1, 0) AS p_sales, lag(inventory) OVER w AS li FROM panel_supplier WINDOW w AS (PARTITION BY comp ORDER BY period))
SELECT comp, period, p_sales, first_value(li IGNORE NULLS) OVER (PARTITION BY comp ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS inventory_sft_1 FROM a""",
    ),
)
def q_merge_features(spark, sf_dir):
    p = panel_supplier(spark, sf_dir)
    a = pct_change(p, SPEC, ["sales"]).select(*KEYS, "p_sales")
    b = lag_backfill(p, SPEC, ["inventory"], 1).select(*KEYS, "inventory_sft_1")
    return merge_all([a, b], KEYS)


@query(
    "q_join_many_to_one",
    with_panels(
        SUPPLIER,
        body="""
, m AS (SELECT sector, period, avg(sales) AS sales FROM panel_supplier GROUP BY 1, 2)
SELECT p.comp, p.period, p.sales, round(m.sales, 3) AS sales_avg FROM panel_supplier p LEFT JOIN m ON p.sector = m.sector AND p.period = m.period""",
    ),
)
def q_join_many_to_one(spark, sf_dir):
    p = panel_supplier(spark, sf_dir)
    means = p.groupBy("sector", "period").agg(F.round(F.avg("sales"), 3).alias("sales"))
    return join_many_to_one(p, means, ["sector", "period"], "_avg").select(*KEYS, "sales", "sales_avg")
