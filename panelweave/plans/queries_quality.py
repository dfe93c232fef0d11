"""Queries for filters, completeness, de-duplication and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import scalars as s
from panelweave.operators import quality as qual
from panelweave.operators import select as sel
from panelweave.operators.gram import pair_correlations
from panelweave.operators.ordered import fill_linear, lag_set
from panelweave.operators.quantiles import exact_quantiles
from panelweave.operators.radix import grouped_quantiles
from panelweave.plans.panel_sql import CUSTOMER, EVENT, RATIOS, SUPPLIER, with_panels
from panelweave.plans.queries_ordered import FILL_LINEAR_SQL
from panelweave.plans.registry import query
from panelweave.plans.views import EVENT_MEASURES, SPEC, SUPPLIER_MEASURES, load, panel_customer, panel_event, panel_supplier, panel_supplier_ratios
from panelweave.spec import q

KEYS = ["comp", "period"]

FILLED = "(purchase IS NOT NULL)::INT + (click IS NOT NULL)::INT + (viewed IS NOT NULL)::INT + (error IS NOT NULL)::INT"
RATED_SQL = f"""
, c AS (SELECT *, {FILLED} AS filled FROM panel_event),
r AS (SELECT *, CAST(filled AS DOUBLE) / (SELECT max(filled) FROM c) AS data_quality FROM c)
"""


@query(
    "q_query_builder",
    """SELECT DISTINCT o_custkey, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_totalprice > 100000)
ORDER BY o_custkey, o_orderpriority LIMIT 500 OFFSET 20""",
)
def q_query_builder(spark, sf_dir):
    return sel.build_query(
        load(spark, sf_dir, "orders"),
        ["o_custkey", "o_orderpriority"],
        {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]},
        "o_totalprice > 100000",
        distinct=True,
        limit=500,
        offset=20,
        order_by=["o_custkey", "o_orderpriority"],
    )


@query(
    "q_drop_empty_rows",
    with_panels(
        CUSTOMER,
        body="SELECT comp, period, sales, n_orders, urgent_avg FROM panel_customer WHERE sales IS NOT NULL OR n_orders IS NOT NULL OR urgent_avg IS NOT NULL",
    ),
)
def q_drop_empty_rows(spark, sf_dir):
    p = panel_customer(spark, sf_dir).select(*KEYS, "sales", "n_orders", "urgent_avg")
    return qual.drop_empty_rows(p, KEYS)


@query(
    "q_required_filter",
    with_panels(CUSTOMER, body="SELECT comp, period, sales, urgent_avg FROM panel_customer WHERE sales IS NOT NULL AND urgent_avg IS NOT NULL"),
)
def q_required_filter(spark, sf_dir):
    return qual.require_columns(panel_customer(spark, sf_dir), ["sales", "urgent_avg"]).select(*KEYS, "sales", "urgent_avg")


@query("q_row_fill_rate", with_panels(EVENT, body=RATED_SQL + "SELECT comp, period, data_quality FROM r WHERE data_quality >= 0.5"))
def q_row_fill_rate(spark, sf_dir):
    rated = qual.row_fill_rate(panel_event(spark, sf_dir), EVENT_MEASURES)
    return rated.filter(F.col("data_quality") >= 0.5).select(*KEYS, "data_quality")


@query("q_row_count", with_panels(EVENT, body=f"SELECT comp, period, CAST({FILLED} AS BIGINT) AS n_filled FROM panel_event"))
def q_row_count(spark, sf_dir):
    p = panel_event(spark, sf_dir)
    return p.select(*KEYS, s.filled_count(*[q(c) for c in EVENT_MEASURES]).cast("bigint").alias("n_filled"))


@query(
    "q_row_fill_quantile",
    with_panels(EVENT, body=RATED_SQL + "SELECT comp, period, n_events FROM r WHERE data_quality >= (SELECT quantile_cont(data_quality, 0.6) FROM r)"),
)
def q_row_fill_quantile(spark, sf_dir):
    return qual.filter_row_quantile(panel_event(spark, sf_dir), EVENT_MEASURES, 0.6).select(*KEYS, "n_events")


@query(
    "q_col_fill_rate",
    with_panels(
        EVENT,
        body="""
, c AS (SELECT count(purchase) AS p, count(click) AS c, count(viewed) AS v, count(error) AS e, count(n_events) AS n FROM panel_event),
l AS (SELECT 'purchase' AS column_name, p AS n_filled FROM c UNION ALL SELECT 'click', c FROM c UNION ALL SELECT 'viewed', v FROM c
      UNION ALL SELECT 'error', e FROM c UNION ALL SELECT 'n_events', n FROM c)
SELECT column_name, n_filled, CAST(n_filled AS DOUBLE) / (SELECT max(n_filled) FROM l) AS fill_rate FROM l""",
    ),
)
def q_col_fill_rate(spark, sf_dir):
    return qual.column_fill_rate(panel_event(spark, sf_dir), [*EVENT_MEASURES, "n_events"])


@query("q_drop_sparse_columns", with_panels(CUSTOMER, body="SELECT comp, industry, data_year, data_qrt, period, sales, n_orders FROM panel_customer"))
def q_drop_sparse_columns(spark, sf_dir):
    return qual.drop_sparse_columns(panel_customer(spark, sf_dir), 0.2)


@query(
    "q_quality_report",
    with_panels(
        EVENT,
        body=RATED_SQL
        + """
, l AS (SELECT greatest(0.3, quantile_cont(data_quality, 0.25)) AS lim FROM r),
f AS (SELECT purchase IS NOT NULL AS ok, data_quality >= (SELECT lim FROM l) AS full_row FROM r)
SELECT count(*) AS n_input, count(*) FILTER (WHERE NOT ok) AS dropped_required,
       count(*) FILTER (WHERE ok AND NOT full_row) AS dropped_fill_rate, count(*) FILTER (WHERE ok AND full_row) AS n_kept,
       CAST(count(*) FILTER (WHERE ok AND full_row) AS DOUBLE) / count(*) AS share_kept FROM f""",
    ),
)
def q_quality_report(spark, sf_dir):
    return qual.quality_report(panel_event(spark, sf_dir), EVENT_MEASURES, ["purchase"], 0.3, 0.25)


@query("q_outlier_range", with_panels(SUPPLIER, body="SELECT comp, period, grossmargin FROM panel_supplier WHERE grossmargin > 4 AND grossmargin < 6"))
def q_outlier_range(spark, sf_dir):
    return qual.open_range(panel_supplier(spark, sf_dir), "grossmargin", 4.0, 6.0).select(*KEYS, "grossmargin")


@query(
    "q_quantile_trim",
    with_panels(
        SUPPLIER,
        body="""
, u AS (SELECT quantile_cont(sales, 0.975) AS a, quantile_cont(inventory, 0.975) AS b FROM panel_supplier),
s1 AS (SELECT p.* FROM panel_supplier p, u WHERE sales < a AND inventory < b),
l AS (SELECT quantile_cont(sales, 0.025) AS a, quantile_cont(inventory, 0.025) AS b FROM s1)
SELECT comp, period, sales, inventory FROM s1, l WHERE sales > a AND inventory > b""",
    ),
)
def q_quantile_trim(spark, sf_dir):
    p = panel_supplier(spark, sf_dir).select(*KEYS, "sales", "inventory")
    return qual.quantile_trim(p, ["sales", "inventory"])


@query(
    "q_quantiles",
    """SELECT round(quantile_cont(l_extendedprice, 0.02), 6) AS q02, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
       round(quantile_cont(l_extendedprice, 0.98), 6) AS q98 FROM lineitem""",
)
def q_quantiles(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_extendedprice")
    # A small bracket makes the refinement run on small test data as well.
    got = exact_quantiles(li, {"l_extendedprice": [0.02, 0.5, 0.98]}, bracket_rows=10_000)["l_extendedprice"]
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(n) for n, v in zip(("q02", "q50", "q98"), got)])


@query(
    "q_group_quantiles",
    """WITH v AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS a, l_discount - 0.05 AS b FROM lineitem)
SELECT l_returnflag, l_linestatus, 'price' AS "column", round(quantile_cont(a, 0.02), 6) AS low, round(quantile_cont(a, 0.5), 6) AS mid, round(quantile_cont(a, 0.98), 6) AS high FROM v GROUP BY ALL
UNION ALL
SELECT l_returnflag, l_linestatus, 'rebate', round(quantile_cont(b, 0.02), 6), round(quantile_cont(b, 0.5), 6), round(quantile_cont(b, 0.98), 6) FROM v GROUP BY ALL""",
)
def q_group_quantiles(spark, sf_dir):
    """Exact quantiles of two columns in every group at once."""
    keys = ["l_returnflag", "l_linestatus"]
    li = load(spark, sf_dir, "lineitem").select(*keys, F.col("l_extendedprice").alias("price"), (F.col("l_discount") - 0.05).alias("rebate"))
    got = grouped_quantiles(li, keys, {c: [0.02, 0.5, 0.98] for c in ("price", "rebate")})
    at = lambda p: F.round(F.max(F.when(F.col("prob") == p, F.col("value"))), 6)
    return got.groupBy(*keys, "column").agg(at(0.02).alias("low"), at(0.5).alias("mid"), at(0.98).alias("high"))


@query(
    "q_low_information",
    with_panels(
        SUPPLIER,
        body="""
, m AS (SELECT CASE WHEN fifovslifo < 0 THEN 1 ELSE 0 END AS flag, inventory, data_qrt FROM panel_supplier),
e AS (SELECT 'flag' AS column_name, CAST(min(flag) AS DOUBLE) AS min_value, CAST(max(flag) AS DOUBLE) AS max_value FROM m
      UNION ALL SELECT 'inventory', min(inventory), max(inventory) FROM m UNION ALL SELECT 'data_qrt', min(data_qrt), max(data_qrt) FROM m)
SELECT column_name, min_value, max_value,
       (min_value, max_value) IN ((-1, 1), (0, 1), (0, 0), (1, 1)) AS low_information FROM e""",
    ),
)
def q_low_information(spark, sf_dir):
    p = panel_supplier(spark, sf_dir).select(s.negative_flag(q("fifovslifo")).alias("flag"), "inventory", "data_qrt")
    return qual.low_information_columns(p, ["flag", "inventory", "data_qrt"])


@query(
    "q_z_score_filter",
    with_panels(
        SUPPLIER,
        body="""
SELECT comp, period FROM panel_supplier,
  (SELECT avg(sales) AS m, stddev_pop(sales) AS s, avg(grossmargin) AS m2, stddev_pop(grossmargin) AS s2 FROM panel_supplier)
WHERE abs((sales - m) / s) < 2 AND abs((grossmargin - m2) / s2) < 2""",
    ),
)
def q_z_score_filter(spark, sf_dir):
    return qual.z_score_filter(panel_supplier(spark, sf_dir), ["sales", "grossmargin"], 2.0).select(*KEYS)


CORR_COLS = ["sales", "netincome", "inventory", "randd", "employeenum", "grossmargin"]


def _corr_sql(tail: str) -> str:
    pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1 :]]
    rows = " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, coalesce(corr({a}, {b}), 0) AS r FROM panel_supplier" for a, b in pairs)
    return with_panels(SUPPLIER, body=f", pairs AS ({rows}) {tail}")


@query("q_corr_pairs", _corr_sql("SELECT col_a, col_b, round(r, 8) AS r FROM pairs"))
def q_corr_pairs(spark, sf_dir):
    return qual.correlation_pairs(panel_supplier(spark, sf_dir), CORR_COLS).withColumn("r", F.round("r", 8))


@query(
    "q_corr_prune",
    _corr_sql("SELECT 'sales' AS column_name, false AS dropped UNION ALL SELECT col_b, bool_or(r >= 0.9) FROM pairs GROUP BY 1"),
)
def q_corr_prune(spark, sf_dir):
    return qual.correlation_prune(panel_supplier(spark, sf_dir), CORR_COLS, 0.9)


WIDE_LAGS = [1, 2, 4]
WIDE_COLS = [*SUPPLIER_MEASURES, *[f"{c}_sft_{k}" for k in WIDE_LAGS for c in SUPPLIER_MEASURES]]


def _wide(spark, sf_dir):
    """Every measure and its lags: 44 columns with gaps."""
    return lag_set(panel_supplier(spark, sf_dir).select(*KEYS, *SUPPLIER_MEASURES), SPEC, {"__all__": WIDE_LAGS})


def _wide_sql(tail: str) -> str:
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}_sft_{k}" for k in WIDE_LAGS for c in SUPPLIER_MEASURES)
    numbers = ", ".join(f"('{c}', {i})" for i, c in enumerate(WIDE_COLS))
    return with_panels(
        SUPPLIER,
        body=f"""
, wide AS (SELECT comp, period, {", ".join(SUPPLIER_MEASURES)}, {lags} FROM panel_supplier WINDOW w AS (PARTITION BY comp ORDER BY period)),
long AS (UNPIVOT wide ON {", ".join(WIDE_COLS)} INTO NAME col VALUE v),
numbered AS (SELECT comp, period, col, place, v FROM long JOIN (VALUES {numbers}) AS t(name, place) ON name = col),
pairs AS (
  SELECT a.col AS col_a, b.col AS col_b, count(*) AS n,
         CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN covar_pop(a.v, b.v) / stddev_pop(a.v) / stddev_pop(b.v) END AS r
  FROM numbered a JOIN numbered b ON a.comp = b.comp AND a.period = b.period AND a.place < b.place GROUP BY 1, 2)
{tail}""",
    )


@query("q_corr_wide", _wide_sql("SELECT col_a, col_b, n, round(r, 6) + 0.0 AS r FROM pairs"))
def q_corr_wide(spark, sf_dir):
    """Pairs that share no row at all are left out, as they are in the SQL."""
    return pair_correlations(_wide(spark, sf_dir), WIDE_COLS).filter("n > 0").withColumn("r", F.round("r", 6) + 0.0)


@query(
    "q_corr_prune_wide",
    _wide_sql(f"SELECT '{WIDE_COLS[0]}' AS column_name, false AS dropped UNION ALL SELECT col_b, coalesce(bool_or(r >= 0.9), false) FROM pairs GROUP BY 1"),
)
def q_corr_prune_wide(spark, sf_dir):
    return qual.correlation_prune(_wide(spark, sf_dir), WIDE_COLS, 0.9)


@query(
    "q_dedupe_most_complete",
    with_panels(
        EVENT,
        body=f"""
SELECT comp, period, purchase, click, viewed, error FROM panel_event
QUALIFY row_number() OVER (PARTITION BY comp ORDER BY {FILLED} DESC, period) = 1""",
    ),
)
def q_dedupe_most_complete(spark, sf_dir):
    return qual.dedupe_most_complete(panel_event(spark, sf_dir), ["comp"], EVENT_MEASURES, ["period"]).select(*KEYS, *EVENT_MEASURES)


@query(
    "q_dedupe_last",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def q_dedupe_last(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return qual.dedupe_last(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "q_cell_diff",
    with_panels(
        CUSTOMER,
        body=FILL_LINEAR_SQL
        + """
, filled AS (SELECT comp, period, coalesce(sales, a + (z - a) / nullif(iz - ia, 0) * (i - ia), a, z) AS sales FROM n)
SELECT p.comp, p.period, 'sales' AS column_name, p.sales AS from_value, f.sales AS to_value
FROM panel_customer p JOIN filled f ON p.comp = f.comp AND p.period = f.period WHERE p.sales IS DISTINCT FROM f.sales""",
    ),
)
def q_cell_diff(spark, sf_dir):
    before = panel_customer(spark, sf_dir).select(*KEYS, "sales", "n_orders")
    return qual.cell_diff(before, fill_linear(before, SPEC, ["sales"]), KEYS, ["sales", "n_orders"])


@query(
    "q_positional_ranges",
    """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)
WHERE p < 100 OR (p >= 500 AND p < 900) OR p >= 14000""",
)
def q_positional_ranges(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sel.position_ranges(o, "o_orderkey", (None, 100), (500, 900), (14000, None))


@query(
    "q_global_position",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders",
)
def q_global_position(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    # Small buckets so that test data is cut as well.
    return sel.with_position(o, "o_totalprice", "pos", ["o_orderkey"]).drop("o_totalprice")


@query("q_period_slice", with_panels(SUPPLIER, body="SELECT comp, period, sales FROM panel_supplier WHERE period BETWEEN 199602 AND 199803"))
def q_period_slice(spark, sf_dir):
    return sel.between_periods(panel_supplier(spark, sf_dir), "period", 199602, 199803).select(*KEYS, "sales")


@query("q_company_filter", with_panels(SUPPLIER, body="SELECT comp, period, sales FROM panel_supplier WHERE comp IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)"))
def q_company_filter(spark, sf_dir):
    chosen = load(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("comp"))
    return sel.keep_members(panel_supplier(spark, sf_dir), chosen, "comp").select(*KEYS, "sales")


@query(
    "q_company_exclude",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)",
)
def q_company_exclude(spark, sf_dir):
    urgent = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return sel.keep_members(load(spark, sf_dir, "customer"), urgent, "c_custkey", exclude=True).select("c_custkey", "c_name")


@query("q_feature_filter", with_panels(SUPPLIER, body="SELECT sales, inventory, randd FROM panel_supplier"))
def q_feature_filter(spark, sf_dir):
    names = sel.include_exclude(SUPPLIER_MEASURES, ["sales", "inventory", "randd", "eps"], ["eps"])
    return panel_supplier(spark, sf_dir).select(*names)


@query("q_numeric_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def q_numeric_columns(spark, sf_dir):
    from panelweave.spec import numeric_columns

    c = load(spark, sf_dir, "customer")
    return c.select(*numeric_columns(c))


@query("q_rename_columns", "SELECT c_custkey AS comp, c_name AS company_name, c_mktsegment FROM customer")
def q_rename_columns(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return sel.rename_columns(c, {"c_custkey": "Comp", "c_name": "Company.Name"})


@query(
    "q_valid_quarters",
    with_panels(CUSTOMER, body="SELECT comp, period, n_orders FROM panel_customer WHERE data_qrt BETWEEN 1 AND 4 AND n_orders IS NOT NULL"),
)
def q_valid_quarters(spark, sf_dir):
    p = panel_customer(spark, sf_dir)
    return p.filter(F.col("data_qrt").between(1, 4) & F.col("n_orders").isNotNull()).select(*KEYS, "n_orders")


RATIO_REPORT = ["orderbacklog", "salestocash", "fcftodebt", "divtofcf"]


@query(
    "q_ratio_fill_rate",
    with_panels(
        RATIOS,
        body="""
, c AS (SELECT count(orderbacklog) AS a, count(salestocash) AS b, count(fcftodebt) AS c, count(divtofcf) AS d FROM panel_ratios),
l AS (SELECT 'orderbacklog' AS column_name, a AS n_filled FROM c UNION ALL SELECT 'salestocash', b FROM c
      UNION ALL SELECT 'fcftodebt', c FROM c UNION ALL SELECT 'divtofcf', d FROM c)
SELECT column_name, n_filled, CAST(n_filled AS DOUBLE) / (SELECT max(n_filled) FROM l) AS fill_rate FROM l
WHERE CAST(n_filled AS DOUBLE) / (SELECT max(n_filled) FROM l) >= 0.66""",
    ),
)
def q_ratio_fill_rate(spark, sf_dir):
    """Columns filled to at least 66 % of the best one: the selection rule of the wide dataset."""
    rates = qual.column_fill_rate(panel_supplier_ratios(spark, sf_dir), RATIO_REPORT)
    return rates.filter(F.col("fill_rate") >= 0.66)


@query(
    "q_distinct_rows",
    "SELECT DISTINCT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS data_year FROM orders",
)
def q_distinct_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("bigint").alias("data_year")).distinct()
