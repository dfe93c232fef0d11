"""Named feature sets. Each is one projection over levels, percent changes, lags and group means.

Output names are fixed: users refer to features by them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.scalars import negative_flag, ratio, zero_if_missing
from panelweave.operators.groups import attach_group_mean, compare_to_group, group_mean, join_group, reduce_to_yearly
from panelweave.operators.ordered import lag_backfill, lag_set, pct_change, season
from panelweave.session import cut_lineage
from panelweave.spec import PanelSpec, q

# Measures that the named sets read.
LEVI_CHANGES = ["inventory", "sales", "capitalexpenditures", "randd", "grossmargin", "sga", "orderbacklog"]
GROUP_MEANS = ["capitalexpenditures", "randd"]
LEVEL_LAGS = ["sales", "employeenum", "dividendperstock"]

# Output name -> measure, for the set read from changes and the set read from levels.
OU_CHANGES = {
    "2_current ratio": "currentratio",
    "4_quick ratio": "quickratio",
    "8_inventory turnover": "inventoryturnover",
    "10_inventory to assets pct": "inventorytoassets",
    "11_inventory": "inventory",
    "12_sales": "sales",
    "13_depreciation": "depreciation",
    "18_ROE pct chg": "roe",
    "19_CAPEX To Assets": "capextoassets",
    "22_debt to equity pct chg": "debttoequity",
    "38_pretax income to sales": "pretaxincometosales",
    "53_total assets": "totalassets",
}
OU_LEVELS = {
    "9_inventory to assets": "inventorytoassets",
    "17_ROE": "roe",
    "21_debt to equity": "debttoequity",
    "30_sales to assets": "salestoassets",
    "31_ROA": "roa",
    "33_gross margin": "grossmargin",
    "41_sales to total cash": "salestocash",
    "54_CF to debt": "fcftodebt",
    "55_WC to assets": "wctoassets",
    "57_OpIncome to assets": "opinctoassets",
    "61_Repayment of LT debt ": "ltdebtrepaypct",
    "66_Cash div to cash flows": "divtofcf",
}
XUE_CHANGES = {
    "1_profit margin": "netprofitmargin",
    "3_ROA chg": "roa",
    "6_Accounts Receivable Turnover": "acctrcvblturnover",
    "7_Inventory Turnover": "inventoryturnover",
    "8_Asset Turnover": "assetturnover",
    "9_Current Ratio": "currentratio",
    "10_Quick Ratio": "quickratio",
    "11_Working Capital": "wc",
}
XUE_LEVELS = {"2_ROA": "roa", "5_Accruals": "assetaccruals"}
TARGETS = {
    "y_eps": "eps",
    "y_dividendyield": "dividendyield",
    "y_dividendperstock": "dividendperstock",
    "y_roe": "roe",
    "y_roa": "roa",
    "y_EBIT": "ebit",
    "y_Net income": "netincome",
}

SETS = ("lev_thi", "ou_penn", "xue_zha")


def _measures(sets: Sequence[str], targets: bool = True) -> list[str]:
    """Measures whose change is needed."""
    wanted: list[str] = []
    if "lev_thi" in sets:
        wanted += LEVI_CHANGES
    if "ou_penn" in sets:
        wanted += OU_CHANGES.values()
    if "xue_zha" in sets:
        wanted += XUE_CHANGES.values()
    if targets:
        wanted += TARGETS.values()
    return list(dict.fromkeys(wanted))


def prepare(df: DataFrame, spec: PanelSpec, sets: Sequence[str] = SETS, targets: bool = True) -> DataFrame:
    """Append everything the sets read: group means, lag 1 of levels, percent changes and one lag 4 of a change.

    Only the measures of the requested sets are touched. Group means need one aggregate and a join; all other
    additions share the window by entity, hence one shuffle and one sort.
    """
    out = df
    changes = _measures(sets, targets)
    if "lev_thi" in sets:
        out = attach_group_mean(out, spec, GROUP_MEANS)
        changes += [f"{c}_avg" for c in GROUP_MEANS]
    lags = [c for c in LEVEL_LAGS if ("lev_thi" in sets and c != "dividendperstock") or ("ou_penn" in sets and c == "dividendperstock")]
    if lags:
        out = lag_backfill(out, spec, lags, 1)
    out = pct_change(out, spec, changes)
    if "ou_penn" in sets:
        out = lag_backfill(out, spec, ["p_capextoassets"], 4)
    return out


def lev_thi_columns() -> dict[str, Column]:
    p = lambda c: q(f"p_{c}")
    staff_before = ratio(q("sales_sft_1"), q("employeenum_sft_1"))
    staff_now = ratio(q("sales"), q("employeenum"))
    return {
        "1_Inventory": p("inventory") - p("sales"),
        "3_CAPX": p("capitalexpenditures_avg") - p("capitalexpenditures"),
        "4_RnD": p("randd_avg") - p("randd"),
        "5_Gross Margin": p("sales") - p("grossmargin"),
        "6_Sales & Admin. Exp.": p("sga") - p("sales"),
        "9_Order Backlog": p("sales") - p("orderbacklog"),
        "10_Labor Force": ratio(ratio(staff_before - staff_now, q("sales_sft_1")), q("employeenum_sft_1")),
        "11_FIFO/LIFO dummy": negative_flag(q("fifovslifo")),
    }


def ou_penn_columns() -> dict[str, Column]:
    out = {name: q(f"p_{m}") for name, m in OU_CHANGES.items()}
    out |= {name: q(m) for name, m in OU_LEVELS.items()}
    out["14_div per share"] = q("dividendperstock") - q("dividendperstock_sft_1")
    out["20_CAPEX To Assets last year"] = q("p_capextoassets_sft_4")
    return out


def xue_zha_inputs() -> dict[str, Column]:
    """The ratios before they are compared with their group."""
    out = {name: q(f"p_{m}") for name, m in XUE_CHANGES.items()}
    out |= {name: q(m) for name, m in XUE_LEVELS.items()}
    out["4_CF to Assets"] = ratio(q("leveredfocf"), q("totalassets"))
    return out


def target_columns(just: Sequence[str] | None = None) -> dict[str, Column]:
    out = {}
    for name, m in TARGETS.items():
        out[name] = q(m)
        out[f"{name} pct"] = q(f"p_{m}")
    return out if just is None else {k: out[k] for k in just}


def _project(df: DataFrame, spec: PanelSpec, cols: Mapping[str, Column]) -> DataFrame:
    return df.select(spec.comp, spec.period, *[c.alias(n) for n, c in cols.items()])


def lev_thi(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Eight fundamental signals."""
    return _project(prepare(df, spec, ["lev_thi"], targets=False), spec, lev_thi_columns())


def ou_penn(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Twenty-six ratio signals."""
    return _project(prepare(df, spec, ["ou_penn"], targets=False), spec, ou_penn_columns())


def xue_zha(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Eleven signals, each 1 when at least the mean of its group and period."""
    ready = prepare(df, spec, ["xue_zha"], targets=False)
    cols = xue_zha_inputs()
    inputs = ready.select(spec.comp, spec.industry, spec.period, *[c.alias(n) for n, c in cols.items()])
    return compare_to_group(inputs, spec, list(cols)).drop(spec.industry)


def targets(df: DataFrame, spec: PanelSpec, just: Sequence[str] | None = None) -> DataFrame:
    """Seven levels and their changes."""
    return _project(prepare(df, spec, [], targets=True), spec, target_columns(just))


def build_features(
    df: DataFrame,
    spec: PanelSpec,
    sets: Sequence[str] = SETS,
    quarter: str | None = None,
    year: str | None = None,
    yearly: bool = False,
    with_lags: bool = False,
    target_range: tuple[float, float] | None = (-3.0, 3.0),
    materialise: bool = False,
) -> DataFrame:
    """The whole feature frame: seasonality, optional yearly reduction, changes, sets, targets, clean-up, outlier cut.

    Sets are columns of one frame, not frames to be merged: only the group comparison (an aggregate) is joined
    back. Missing and infinite features become 0; rows whose ``y_eps pct`` lies outside ``target_range`` go.

    The panel is read for its rows and for its group means. Where it is derived from raw rows, ``materialise``
    writes it to the checkpoint folder first, so that the raw table is scanned once.
    """
    if materialise:
        df = cut_lineage(df)
    base = season(df, quarter) if quarter else df
    extra = [c for c in ("t_qrt_sin", "t_qrt_cos") if quarter]
    if yearly:
        year, quarter = year or "data_year", quarter or "data_qrt"
        base = reduce_to_yearly(base, spec, "eps", year, quarter).withColumn(spec.period, q(year) * 100 + q(quarter))
    ready = prepare(base, spec, sets)
    cols: dict[str, Column] = {}
    if "lev_thi" in sets:
        cols |= lev_thi_columns()
    if "ou_penn" in sets:
        cols |= ou_penn_columns()
    compared: dict[str, Column] = xue_zha_inputs() if "xue_zha" in sets else {}
    cols |= target_columns()
    wide = ready.select(
        spec.comp,
        spec.industry,
        spec.period,
        *extra,
        *[c.alias(n) for n, c in cols.items()],
        *[c.alias(f"__in_{n}") for n, c in compared.items()],
    )
    if compared:
        keys = [spec.industry, spec.period]
        means = group_mean(wide, keys, [f"__in_{n}" for n in compared], "__mean")
        joined = join_group(wide, means, keys, spread_by=spec.comp)
        flags = {n: F.when(q(f"__in_{n}") >= q(f"__in_{n}__mean"), 1).otherwise(0).cast("bigint") for n in compared}
        wide = joined.select(spec.comp, spec.industry, spec.period, *extra, *[q(n) for n in cols], *[c.alias(n) for n, c in flags.items()])
    names = [*cols, *compared]
    out = wide.select(spec.comp, spec.period, *extra, *[q(n) for n in names])
    if with_lags:
        out = lag_set(out, spec, {"__all__": [2, 4]}, exclude=extra)
        names = [c for c in out.columns if c not in (spec.comp, spec.period, *extra)]
    floats = [n for n, t in out.dtypes if t in ("double", "float") and n in names]
    out = out.select(
        spec.comp,
        spec.period,
        *extra,
        *[zero_if_missing(q(n)).alias(n) if n in floats else F.coalesce(q(n), F.lit(0).cast("bigint")).alias(n) for n in names],
    )
    if target_range:
        low, high = target_range
        out = out.filter((q("y_eps pct") > low) & (q("y_eps pct") < high))
    return out
