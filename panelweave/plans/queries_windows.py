"""Queries for windows, splits, samples, normalisation, baselines and error tables.

The window is I = 4 input periods, P = 1 target period, T = 10 train windows, one val and one test window,
over the 28 supplier quarters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.metrics import ERROR_METRICS
from panelweave.operators import evaluate as ev
from panelweave.operators import scale as sc
from panelweave.operators import windows as win
from panelweave.operators.ordered import keep_last_steps, pct_change
from panelweave.operators.select import random_examples
from panelweave.plans.panel_sql import EVENT, SUPPLIER, with_panels
from panelweave.plans.prepare import SamplePlan, Samples
from panelweave.plans.registry import query
from panelweave.plans.views import EVENT_MEASURES, SPEC, load, panel_event, panel_supplier
from panelweave.session import new_folder
from panelweave.sources.tables import cached_result
from panelweave.spec import q

KEYS = ["comp", "period"]
FEATURES = ["sales", "inventory", "orderbacklog"]

# Windows by closed form: L = block start, 16 periods per block.
PERIODS_SQL = """
, per AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS idx FROM (SELECT DISTINCT period FROM {panel})),
np AS (SELECT count(*) AS n FROM per)"""
WINDOWS_SQL = (
    PERIODS_SQL.format(panel="panel_supplier")
    + """,
blk AS (SELECT idx AS lo, idx + 15 AS hi FROM per, np WHERE idx + 15 < n),
ws AS (SELECT lo, hi, 'train' AS split, lo + k AS start FROM blk, (SELECT unnest(generate_series(0, 9)) AS k)
       UNION ALL SELECT lo, hi, 'val', hi - 5 FROM blk UNION ALL SELECT lo, hi, 'test', hi - 4 FROM blk),
windows AS (SELECT a.period || '_' || b.period AS block, ws.split, ws.start, ws.start + 4 AS "end", c.period AS lower, d.period AS upper
            FROM ws JOIN per a ON ws.lo = a.idx JOIN per b ON ws.hi = b.idx JOIN per c ON ws.start = c.idx JOIN per d ON ws.start + 4 = d.idx)"""
)
INDEXED_SQL = WINDOWS_SQL + ", pi AS (SELECT p.*, per.idx FROM panel_supplier p JOIN per ON p.period = per.period)"
COMPLETE_SQL = (
    INDEXED_SQL
    + """, full_s AS (SELECT s.start, p.comp FROM (SELECT DISTINCT start FROM windows) s JOIN pi p ON p.idx BETWEEN s.start AND s.start + 4
                    GROUP BY 1, 2 HAVING count(DISTINCT p.idx) = 5),
smp AS (SELECT w.*, f.comp FROM windows w JOIN full_s f ON w.start = f.start)"""
)


def supplier_plan(spark, sf_dir, features=FEATURES, targets=("sales",), panel=None):
    panel = panel if panel is not None else panel_supplier(spark, sf_dir)
    return SamplePlan(panel, SPEC, list(features), list(targets)).window(4, 1).block_rolling_split(10)


@query("q_windows_block_rolling", with_panels(SUPPLIER, body=WINDOWS_SQL + ' SELECT block, split, start, "end", lower, upper FROM windows'))
def q_windows_block_rolling(spark, sf_dir):
    p = panel_supplier(spark, sf_dir)
    return win.windows_table(win.calendar(p, SPEC), SPEC, win.WindowSize(4), 10)


@query(
    "q_windows_single_step",
    with_panels(
        SUPPLIER,
        body=PERIODS_SQL.format(panel="panel_supplier")
        + """, blk AS (SELECT idx AS lo, idx + 6 AS hi FROM per, np WHERE idx + 6 < n),
ws AS (SELECT lo, hi, 'train' AS split, lo AS start FROM blk UNION ALL SELECT lo, hi, 'val', lo + 1 FROM blk UNION ALL SELECT lo, hi, 'test', lo + 2 FROM blk)
SELECT a.period || '_' || b.period AS block, split, c.period AS lower, d.period AS upper
FROM ws JOIN per a ON lo = a.idx JOIN per b ON hi = b.idx JOIN per c ON start = c.idx JOIN per d ON start + 4 = d.idx""",
    ),
)
def q_windows_single_step(spark, sf_dir):
    plan = SamplePlan(panel_supplier(spark, sf_dir), SPEC, ["sales"], ["sales"]).window(4, 1).single_time_rolling()
    return plan.compute(materialise=True).windows.select("block", "split", "lower", "upper")


@query(
    "q_windows_static_split",
    with_panels(
        SUPPLIER,
        body=PERIODS_SQL.format(panel="panel_supplier")
        + """, nw AS (SELECT n - 4 AS nw FROM np),
b AS (SELECT nw - CAST(floor(round(nw * 0.3, 9)) AS BIGINT) AS v, nw - CAST(floor(round(nw * 0.1, 9)) AS BIGINT) AS t FROM nw),
lim AS (SELECT (SELECT period FROM per WHERE idx = v) AS val_low, (SELECT period FROM per WHERE idx = t) AS test_low,
               (SELECT period FROM per WHERE idx = v + 4) AS train_high, (SELECT period FROM per WHERE idx = t + 4) AS val_high FROM b),
cr AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT comp FROM panel_supplier)),
g AS (SELECT comp, CASE WHEN r >= CAST(floor(round(0.9 * n, 9)) AS BIGINT) THEN 'test' WHEN r >= CAST(floor(round(0.8 * n, 9)) AS BIGINT) THEN 'val' ELSE 'none' END AS grp FROM cr),
x AS (SELECT p.comp, p.period, p.sales, g.grp, lim.* FROM panel_supplier p JOIN g ON p.comp = g.comp CROSS JOIN lim)
SELECT comp, period, sales, 'train' AS split FROM x WHERE grp = 'none' AND period < train_high
UNION ALL SELECT comp, period, sales, 'val' FROM x WHERE grp = 'val' OR (period >= val_low AND period < val_high)
UNION ALL SELECT comp, period, sales, 'test' FROM x WHERE grp = 'test' OR period >= test_low""",
    ),
)
def q_windows_static_split(spark, sf_dir):
    p = panel_supplier(spark, sf_dir).select(*KEYS, "sales")
    return SamplePlan(p, SPEC, ["sales"], ["sales"]).window(4, 1).static_split(0.2, 0.1, 0.1, 0.1)


@query(
    "q_rows_in_windows",
    with_panels(
        SUPPLIER,
        body=INDEXED_SQL + " SELECT w.block, w.split, w.lower, count(*) AS n, sum(p.inventory) AS inventory FROM windows w JOIN pi p ON p.idx BETWEEN w.start AND w.start + 4 GROUP BY 1, 2, 3",
    ),
)
def q_rows_in_windows(spark, sf_dir):
    p = panel_supplier(spark, sf_dir).select(*KEYS, "inventory")
    cal = win.calendar(p, SPEC)
    size = win.WindowSize(4)
    rows = win.rows_in_windows(win.with_index(p, SPEC, cal), win.windows_table(cal, SPEC, size, 10), size)
    return rows.groupBy("block", "split", "lower").agg(F.count(F.lit(1)).alias("n"), F.sum("inventory").alias("inventory"))


@query(
    "q_sample_long",
    with_panels(
        SUPPLIER,
        body=COMPLETE_SQL
        + """
SELECT s.block, s.split, s.lower, s.upper, s.comp, p.idx - s.start AS step, p.sales, p.inventory, p.orderbacklog
FROM smp s JOIN pi p ON p.comp = s.comp AND p.idx BETWEEN s.start AND s.start + 3""",
    ),
)
def q_sample_long(spark, sf_dir):
    long = supplier_plan(spark, sf_dir).compute(materialise=True).long()
    return long.select("block", "split", "lower", "upper", "comp", "step", *FEATURES)


@query(
    "q_sample_cache",
    with_panels(
        SUPPLIER,
        body=COMPLETE_SQL
        + """
SELECT s.block, s.split, s.comp, s.lower, p.idx - s.start AS step, p.sales
FROM smp s JOIN pi p ON p.comp = s.comp AND p.idx BETWEEN s.start AND s.start + 3 WHERE s.split = 'val'""",
    ),
)
def q_sample_cache(spark, sf_dir):
    """Samples written by block and split; the val folders alone are read back."""
    made = supplier_plan(spark, sf_dir).compute(materialise=True)
    path = new_folder(spark, "sample-cache")
    made.write(path)
    kept = spark.read.schema(made.samples.schema).parquet(path).filter("split = 'val'")
    return win.samples_long(kept, SPEC, FEATURES).select("block", "split", "comp", "lower", "step", "sales")


@query(
    "q_sample_export",
    with_panels(
        SUPPLIER,
        body=COMPLETE_SQL
        + """
SELECT s.block, s.split, s.lower, s.upper, s.comp, p.idx - s.start AS step, p.sales, p.inventory, p.orderbacklog, t.sales AS target_sales
FROM smp s JOIN pi p ON p.comp = s.comp AND p.idx BETWEEN s.start AND s.start + 3 JOIN pi t ON t.comp = s.comp AND t.idx = s.start + 4""",
    ),
)
def q_sample_export(spark, sf_dir):
    """Samples exported as CSV with their properties alongside, read back with the schemas of their card."""
    path = new_folder(spark, "sample-export")
    supplier_plan(spark, sf_dir).compute(materialise=True).export(path)
    read = Samples.read_export(spark, path)
    keys = ["block", "split", "comp", "lower"]
    return read["steps"].join(read["samples"].select(*keys, "target_sales"), keys).select(*keys, "upper", "step", *FEATURES, "target_sales")


@query(
    "q_result_cache",
    with_panels(
        SUPPLIER,
        body=""", kept AS (SELECT comp, period, sales, orderbacklog FROM panel_supplier WHERE orderbacklog IS NOT NULL)
SELECT kept.*, (SELECT count(*) FROM panel_supplier) AS n_before, (SELECT count(*) FROM kept) AS n_after FROM kept""",
    ),
)
def q_result_cache(spark, sf_dir):
    """A cleaned panel kept under the fingerprint of its parameters with its report; asked for again it is read, not built."""
    p = panel_supplier(spark, sf_dir).select(*KEYS, "sales", "orderbacklog")

    def build():
        report = p.agg(F.count(F.lit(1)).alias("n_before"), F.count("orderbacklog").alias("n_after"))
        return p.filter("orderbacklog IS NOT NULL"), report

    root, params = new_folder(spark, "results"), {"panel": "supplier", "required": ["orderbacklog"]}
    cached_result(spark, root, params, build)
    # The second request finds the result: there is nothing it could build from.
    data, report = cached_result(spark, root, dict(reversed(params.items())), lambda: (None, None))
    counts = report.first()
    return data.select("*", F.lit(counts["n_before"]).alias("n_before"), F.lit(counts["n_after"]).alias("n_after"))


@query(
    "q_sample_duplicates",
    with_panels(
        SUPPLIER,
        body=COMPLETE_SQL
        + """
SELECT s.block, s.split, s.lower, s.comp, p.idx - s.start AS step, p.sales + CASE WHEN p.comp % 3 = 0 AND p.period % 2 = 1 THEN p.comp ELSE 0 END AS sales
FROM smp s JOIN pi p ON p.comp = s.comp AND p.idx BETWEEN s.start AND s.start + 3""",
    ),
)
def q_sample_duplicates(spark, sf_dir):
    """A panel with several versions of a row: the last version of each (entity, period) counts, every sample is whole."""
    p = panel_supplier(spark, sf_dir).select(*KEYS, "sales", F.lit(0).alias("version"))
    again = p.filter("comp % 3 = 0 AND period % 2 = 1")
    later = again.select(*KEYS, (F.col("sales") + F.col("comp")).alias("sales"), F.lit(2).alias("version"))
    between = again.select(*KEYS, F.lit(-1.0).alias("sales"), F.lit(1).alias("version"))
    plan = SamplePlan(later.unionByName(p).unionByName(between), SPEC, ["sales"], ["sales"], latest_by=["version"]).window(4, 1).block_rolling_split(10)
    return plan.compute(materialise=True).long().select("block", "split", "lower", "comp", "step", "sales")


@query(
    "q_target_filter",
    with_panels(
        SUPPLIER,
        body=COMPLETE_SQL
        + """
SELECT s.block, s.split, s.comp, s.lower, x.sales AS sales, y.inventory AS target_inventory FROM smp s
JOIN pi x ON x.comp = s.comp AND x.idx = s.start + 3 JOIN pi y ON y.comp = s.comp AND y.idx = s.start + 4""",
    ),
)
def q_target_filter(spark, sf_dir):
    """Targets chosen by name after the plan is set up."""
    plan = supplier_plan(spark, sf_dir, ["sales"], ["sales", "inventory", "orderbacklog"]).filter_y(just_include=["inventory"])
    return plan.compute(materialise=True).last_step().select("block", "split", "comp", "lower", "sales", "target_inventory")


@query(
    "q_sample_rejects",
    with_panels(
        EVENT,
        body=PERIODS_SQL.format(panel="panel_event")
        + """,
st AS (SELECT idx AS start, period AS lower, (SELECT b.period FROM per b WHERE b.idx = per.idx + 4) AS upper FROM per, np WHERE idx + 4 < n),
c AS (SELECT DISTINCT comp FROM panel_event),
e AS (SELECT comp, per.idx FROM panel_event JOIN per ON panel_event.period = per.period),
k AS (SELECT c.comp, st.lower, st.upper, count(e.idx) AS n FROM c CROSS JOIN st LEFT JOIN e ON e.comp = c.comp AND e.idx BETWEEN st.start AND st.start + 4
      GROUP BY 1, 2, 3)
SELECT comp, lower, upper, 'comp ' || comp || ' has ' || CASE WHEN n = 0 THEN 'no data' ELSE 'too few time points' END || ' in periods ' || lower || '-' || upper AS message
FROM k WHERE n <> 5""",
    ),
)
def q_sample_rejects(spark, sf_dir):
    plan = SamplePlan(panel_event(spark, sf_dir), SPEC, EVENT_MEASURES, ["purchase"]).window(4, 1).block_rolling_split(10)
    return plan.compute(materialise=True).rejects


NORM_AGG = """avg({c}) AS mean, CASE WHEN count(*) > 1 THEN sqrt(var_pop({c}) * count({c}) / (count(*) - 1)) END AS std"""


def _norm_sql(keys: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS feature, {NORM_AGG.format(c=c)} FROM {source} GROUP BY {keys}" for c in FEATURES)


def _scaled_sql(norm: str, on: str) -> str:
    """Long scaled samples given a norm table joined on ``on``."""
    cols = ", ".join(
        f"""round(coalesce((p.{c} - coalesce(max(CASE WHEN n.feature = '{c}' THEN n.mean END), 0))
             / nullif(coalesce(max(CASE WHEN n.feature = '{c}' THEN n.std END), 1), 0), 0), 6) AS {c}"""
        for c in FEATURES
    )
    return f"""
, norm AS ({norm})
SELECT s.block, s.split, s.lower, s.comp, p.idx - s.start AS step, {cols}
FROM smp s JOIN pi p ON p.comp = s.comp AND p.idx BETWEEN s.start AND s.start + 3 JOIN norm n ON {on}
GROUP BY s.block, s.split, s.lower, s.comp, p.idx, s.start, {", ".join("p." + c for c in FEATURES)}"""


def _scaled(spark, sf_dir, method):
    long = supplier_plan(spark, sf_dir).normalize(method).compute(materialise=True).long()
    return long.select("block", "split", "lower", "comp", "step", *[F.round(c, 6).alias(c) for c in FEATURES])


IN_WINDOW = "(SELECT st.start, pi.* FROM (SELECT DISTINCT start FROM windows) st JOIN pi ON pi.idx BETWEEN st.start AND st.start + 4)"


@query("q_norm_time", with_panels(SUPPLIER, body=COMPLETE_SQL + _scaled_sql(_norm_sql("start", IN_WINDOW), "n.start = s.start")))
def q_norm_time(spark, sf_dir):
    return _scaled(spark, sf_dir, "time")


@query("q_norm_set", with_panels(SUPPLIER, body=COMPLETE_SQL + _scaled_sql(_norm_sql("start, comp", IN_WINDOW), "n.start = s.start AND n.comp = s.comp")))
def q_norm_set(spark, sf_dir):
    return _scaled(spark, sf_dir, "set")


IN_BLOCK = "(SELECT b.block, pi.* FROM (SELECT block, min(start) AS lo, max(\"end\") AS hi FROM windows WHERE split = 'train' GROUP BY 1) b JOIN pi ON pi.idx BETWEEN b.lo AND b.hi)"


@query("q_norm_block", with_panels(SUPPLIER, body=COMPLETE_SQL + _scaled_sql(_norm_sql("block", IN_BLOCK), "n.block = s.block")))
def q_norm_block(spark, sf_dir):
    return _scaled(spark, sf_dir, "block")


@query(
    "q_norm_params",
    with_panels(SUPPLIER, body=INDEXED_SQL + f", norm AS ({_norm_sql('start', IN_WINDOW)}) SELECT start, feature, round(mean, 3) AS mean, round(std, 3) AS std FROM norm"),
)
def q_norm_params(spark, sf_dir):
    norm = supplier_plan(spark, sf_dir).normalize("time").compute(materialise=True).norm
    return norm.select("start", "feature", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


@query(
    "q_unscale",
    with_panels(
        SUPPLIER,
        body=COMPLETE_SQL + " SELECT s.block, s.split, s.lower, s.comp, p.idx - s.start AS step, p.inventory FROM smp s JOIN pi p ON p.comp = s.comp AND p.idx BETWEEN s.start AND s.start + 3",
    ),
)
def q_unscale(spark, sf_dir):
    """Normalise, then go back: the original values return."""
    done = supplier_plan(spark, sf_dir, ["inventory"], ["inventory"]).normalize("time").compute(materialise=True)
    wide = sc.widen_norm(done.norm, ["start"], ["inventory"])
    long = done.long().join(wide, "start")
    raw = sc.unscaled(q("inventory"), q("__mean_inventory"), q("__std_inventory"))
    return long.select("block", "split", "lower", "comp", "step", F.round(raw, 6).alias("inventory"))


@query(
    "q_robust_scale",
    with_panels(
        SUPPLIER,
        body="""
, t AS (SELECT quantile_cont(sales, 0.98) - quantile_cont(sales, 0.02) AS a, quantile_cont(inventory, 0.98) - quantile_cont(inventory, 0.02) AS b
        FROM panel_supplier WHERE period < 200001)
SELECT comp, period, round(sales / a, 8) AS sales, round(inventory / b, 8) AS inventory FROM panel_supplier, t""",
    ),
)
def q_robust_scale(spark, sf_dir):
    p = panel_supplier(spark, sf_dir).select(*KEYS, "sales", "inventory")
    params = sc.robust_params(p.filter("period < 200001"), ["sales", "inventory"])
    return sc.robust_scale(p, params).select(*KEYS, *[F.round(c, 8).alias(c) for c in ("sales", "inventory")])


@query(
    "q_robust_scale_centred",
    with_panels(
        SUPPLIER,
        body="""
, t AS (SELECT quantile_cont(sales, 0.75) - quantile_cont(sales, 0.25) AS a, quantile_cont(sales, 0.5) AS m FROM panel_supplier WHERE period < 200001)
SELECT comp, period, round((sales - m) / a, 8) AS sales FROM panel_supplier, t""",
    ),
)
def q_robust_scale_centred(spark, sf_dir):
    p = panel_supplier(spark, sf_dir).select(*KEYS, "sales")
    params = sc.robust_params(p.filter("period < 200001"), ["sales"], 0.25, 0.75)
    return sc.robust_scale(p, params, centering=True).select(*KEYS, F.round("sales", 8).alias("sales"))


@query(
    "q_robust_scale_blocks",
    with_panels(
        SUPPLIER,
        body=COMPLETE_SQL + """
, lng AS (SELECT s.block, s.split, s.lower, s.comp, p.idx - s.start AS step, p.inventory FROM smp s JOIN pi p ON p.comp = s.comp AND p.idx BETWEEN s.start AND s.start + 3)
, t AS (SELECT block, quantile_cont(inventory, 0.98) - quantile_cont(inventory, 0.02) AS a, quantile_cont(inventory, 0.5) AS m FROM lng WHERE split = 'train' GROUP BY block)
SELECT block, split, lower, comp, step, round((inventory - coalesce(m, 0)) / coalesce(nullif(a, 0), 1), 8) AS inventory FROM lng LEFT JOIN t USING (block)""",
    ),
)
def q_robust_scale_blocks(spark, sf_dir):
    """Median and quantile range of each block's own train rows scale all of its splits."""
    long = supplier_plan(spark, sf_dir, ["inventory"], ["inventory"]).compute(materialise=True).long()
    params = sc.robust_params_by(long.filter("split = 'train'"), ["block"], ["inventory"])
    done = sc.robust_scale_by(long, params, ["block"], ["inventory"], centering=True)
    return done.select("block", "split", "lower", "comp", "step", F.round("inventory", 8).alias("inventory"))


@query(
    "q_standard_scale",
    with_panels(
        SUPPLIER,
        body="""
, t AS (SELECT avg(sales) AS m, stddev_pop(sales) AS s FROM panel_supplier WHERE period < 200001)
SELECT comp, period, round((sales - m) / s, 8) AS sales FROM panel_supplier, t""",
    ),
)
def q_standard_scale(spark, sf_dir):
    p = panel_supplier(spark, sf_dir).select(*KEYS, "sales")
    return sc.standard_scale(p, sc.standard_params(p.filter("period < 200001"), ["sales"])).select(*KEYS, F.round("sales", 8).alias("sales"))


@query(
    "q_complete_series",
    with_panels(
        SUPPLIER,
        body=INDEXED_SQL
        + """, b AS (SELECT min(CASE WHEN split = 'train' THEN lower END) AS lo, max(CASE WHEN split = 'train' THEN upper END) AS t,
                      max(CASE WHEN split = 'val' THEN upper END) AS v, max(CASE WHEN split = 'test' THEN upper END) AS hi
                      FROM windows WHERE block = (SELECT min(block) FROM windows)),
c AS (SELECT comp FROM panel_supplier, b WHERE period BETWEEN lo AND hi GROUP BY 1
      HAVING count(orderbacklog) = (SELECT count(*) FROM per, b WHERE period BETWEEN lo AND hi))
SELECT p.comp, p.period, p.orderbacklog, CASE WHEN p.period <= t THEN 'train' WHEN p.period <= v THEN 'val' ELSE 'test' END AS split
FROM panel_supplier p, b WHERE p.period BETWEEN lo AND hi AND p.comp IN (SELECT comp FROM c)""",
    ),
)
def q_complete_series(spark, sf_dir):
    done = supplier_plan(spark, sf_dir, ["orderbacklog"], ["orderbacklog"]).compute(materialise=True)
    return done.series(done.blocks()[0], "orderbacklog")


STATS_SQL = " SELECT block, split, count(*) AS samples, count(DISTINCT comp) AS companies, CAST(3 AS BIGINT) AS features, count(DISTINCT start) AS time_steps, min(lower) AS time_min, max(upper) AS time_max FROM smp {where} GROUP BY 1, 2"


@query("q_split_stats", with_panels(SUPPLIER, body=COMPLETE_SQL + STATS_SQL.format(where="")))
def q_split_stats(spark, sf_dir):
    return supplier_plan(spark, sf_dir).compute(materialise=True).statistics()


@query("q_block_access", with_panels(SUPPLIER, body=COMPLETE_SQL + STATS_SQL.format(where="WHERE block = (SELECT max(block) FROM windows)")))
def q_block_access(spark, sf_dir):
    done = supplier_plan(spark, sf_dir).compute(materialise=True)
    return ev.split_statistics(done[len(done) - 1], SPEC, len(FEATURES))


@query(
    "q_sample_filters",
    with_panels(
        SUPPLIER,
        body=COMPLETE_SQL
        + """
SELECT s.block, s.split, s.comp, s.lower, p.idx - s.start AS step, p.inventory FROM smp s JOIN pi p ON p.comp = s.comp AND p.idx BETWEEN s.start AND s.start + 3
WHERE s.comp NOT IN (3, 4, 5)""",
    ),
)
def q_sample_filters(spark, sf_dir):
    plan = supplier_plan(spark, sf_dir).filter_features(exclude=["sales", "orderbacklog"]).filter_companies(exclude=[3, 4, 5])
    return plan.compute(materialise=True).long().select("block", "split", "comp", "lower", "step", "inventory")


@query(
    "q_last_step",
    with_panels(
        SUPPLIER,
        body=COMPLETE_SQL
        + """
SELECT s.block, s.split, s.comp, s.lower, x.inventory, y.sales AS target_sales FROM smp s
JOIN pi x ON x.comp = s.comp AND x.idx = s.start + 3 JOIN pi y ON y.comp = s.comp AND y.idx = s.start + 4""",
    ),
)
def q_last_step(spark, sf_dir):
    return supplier_plan(spark, sf_dir, ["inventory"], ["sales"]).compute(materialise=True).last_step().select("block", "split", "comp", "lower", "inventory", "target_sales")


@query(
    "q_keep_last_steps",
    with_panels(
        SUPPLIER,
        body=COMPLETE_SQL
        + """
SELECT s.block, s.split, s.comp, s.lower, a.sales AS x_0, a.inventory AS x_1, b.sales AS x_2, b.inventory AS x_3 FROM smp s
JOIN pi a ON a.comp = s.comp AND a.idx = s.start + 2 JOIN pi b ON b.comp = s.comp AND b.idx = s.start + 3""",
    ),
)
def q_keep_last_steps(spark, sf_dir):
    """The last two steps of each sample as one flat vector."""
    done = supplier_plan(spark, sf_dir, ["sales", "inventory"], ["sales"]).compute(materialise=True)
    flat = done.samples.select("block", "split", "comp", "lower", win.flatten_steps(keep_last_steps(F.col("x"), 2), ["sales", "inventory"]).alias("v"))
    return flat.select("block", "split", "comp", "lower", *[F.col("v")[i].alias(f"x_{i}") for i in range(4)])


@query(
    "q_target_axes",
    with_panels(
        SUPPLIER,
        body=PERIODS_SQL.format(panel="panel_supplier")
        + """, pi AS (SELECT p.comp, per.idx, p.sales, p.inventory FROM panel_supplier p JOIN per ON p.period = per.period),
l AS (SELECT comp, idx AS start, lead(idx, 5) OVER w AS last_idx, lead(sales, 4) OVER w AS s1, lead(sales, 5) OVER w AS s2,
             lead(inventory, 4) OVER w AS i1, lead(inventory, 5) OVER w AS i2 FROM pi WINDOW w AS (PARTITION BY comp ORDER BY idx)),
blk AS (SELECT idx AS lo, idx + 16 AS hi FROM per, np WHERE idx + 16 < n),
ws AS (SELECT lo, hi, 'train' AS split, lo + k AS start FROM blk, (SELECT unnest(generate_series(0, 7)) AS k)
       UNION ALL SELECT lo, hi, 'val', hi - 7 FROM blk UNION ALL SELECT lo, hi, 'test', hi - 5 FROM blk)
SELECT a.period || '_' || b.period AS block, ws.split, l.comp, c.period AS lower, s1 AS sales_1, s2 AS sales_2, i1 AS inventory_1, i2 AS inventory_2
FROM ws JOIN l ON l.start = ws.start AND l.last_idx = l.start + 5 JOIN per a ON ws.lo = a.idx JOIN per b ON ws.hi = b.idx JOIN per c ON ws.start = c.idx""",
    ),
)
def q_target_axes(spark, sf_dir):
    """[horizon][target] -> [target][horizon] for two targets and two horizons."""
    plan = SamplePlan(panel_supplier(spark, sf_dir), SPEC, ["sales"], ["sales", "inventory"]).window(4, 2).block_rolling_split(8)
    y = win.swap_target_axes(F.col("y"), ["sales", "inventory"])
    flat = plan.compute(materialise=True).samples.select("block", "split", "comp", "lower", y.alias("y"))
    cells = [F.col("y")[t][h].alias(f"{n}_{h + 1}") for t, n in enumerate(("sales", "inventory")) for h in (0, 1)]
    return flat.select("block", "split", "comp", "lower", *cells)


@query("q_examples")
def q_examples(spark, sf_dir):
    """Five test samples drawn by a seeded hash, with history and truth."""
    done = supplier_plan(spark, sf_dir).compute(materialise=True)
    return random_examples(done.samples.filter("split = 'test'"), ["block", "comp", "start"], 5, seed=11)


# ---- baselines over the percent change of earnings per unit ----------------------------------------------

PCT_SQL = """
, ch AS (SELECT p.*, coalesce(eps / nullif(lag(eps) OVER (PARTITION BY comp ORDER BY period), 0) - 1, 0) AS p_eps FROM pi p)"""
# A sample is complete, so the next four rows of its entity are the next four periods.
TRUTH_SQL = (
    COMPLETE_SQL
    + PCT_SQL
    + """, ld AS (SELECT comp, idx, p_eps AS x0, lead(p_eps, 1) OVER w AS x1, lead(p_eps, 2) OVER w AS x2, lead(p_eps, 3) OVER w AS x3,
              lead(p_eps, 4) OVER w AS t FROM ch WINDOW w AS (PARTITION BY comp ORDER BY idx)),
sx AS MATERIALIZED (SELECT s.block, s.split, s.start, s.comp, ld.t, ld.x0, ld.x1, ld.x2, ld.x3 FROM smp s JOIN ld ON ld.comp = s.comp AND ld.idx = s.start)"""
)
METRICS_SQL = """count(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(avg((p - t) * (p - t)), 6) AS mse,
  round(avg(power(ln(greatest(t, 1e-7) + 1) - ln(greatest(p, 1e-7) + 1), 2)), 6) AS msle,
  round(avg(abs(t - p) / greatest(abs(t), 1e-7)) * 100, 2) AS mape,
  round(avg(CASE WHEN abs(p - t) <= 1 THEN 0.5 * (p - t) * (p - t) ELSE abs(p - t) - 0.5 END), 6) AS huber,
  round(avg(CASE WHEN sign(t) = sign(p) OR round_even(t * 10, 0) = round_even(p * 10, 0) THEN 1.0 ELSE 0.0 END), 6) AS mda,
  round(avg(CASE WHEN sign(round_even(t * 1000000, 0)) = 1 THEN 1.0 ELSE 0.0 END), 6) AS pos,
  round(avg(CASE WHEN sign(round_even(t * 1000000, 0)) = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero,
  round(avg(CASE WHEN sign(round_even(t * 1000000, 0)) = -1 THEN 1.0 ELSE 0.0 END), 6) AS neg,
  round(1 - avg((p - t) * (p - t)) / avg(abs(t)), 6) AS one_minus_mse_ratio,
  round(1 - avg(abs(p - t)) / avg(abs(t)), 6) AS one_minus_mae_ratio"""
METRICS = list(ERROR_METRICS)


def eps_samples(spark, sf_dir):
    changed = pct_change(panel_supplier(spark, sf_dir), SPEC, ["eps"])
    return supplier_plan(spark, sf_dir, ["p_eps"], ["p_eps"], changed.select(*KEYS, "p_eps")).compute(materialise=True).samples


def rounded_errors(preds, keys):
    errors = ev.errors_by(preds, keys)
    return errors.select(*keys, "n", *[F.round(m, 2 if m == "mape" else 6).alias(m) for m in METRICS])


@query("q_error_metrics", with_panels(SUPPLIER, body=TRUTH_SQL + f" SELECT block, split, {METRICS_SQL} FROM (SELECT *, x3 AS p FROM sx) GROUP BY 1, 2"))
def q_error_metrics(spark, sf_dir):
    return rounded_errors(ev.last_value_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps"), ["block", "split"])


@query("q_baseline_last", with_panels(SUPPLIER, body=TRUTH_SQL + " SELECT block, split, start, comp, t AS y_true, x3 AS y_pred FROM sx"))
def q_baseline_last(spark, sf_dir):
    return ev.last_value_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps").select("block", "split", "start", "comp", "y_true", "y_pred")


AVG_SQL = """, cand AS (SELECT block, split, 1.0 AS candidate, t, x3 AS p FROM sx UNION ALL SELECT block, split, 2.0, t, (x2 + x3) / 2 FROM sx
      UNION ALL SELECT block, split, 3.0, t, (x1 + x2 + x3) / 3 FROM sx UNION ALL SELECT block, split, 4.0, t, (x0 + x1 + x2 + x3) / 4 FROM sx)"""
STATIC_SQL = ", cand AS (SELECT block, split, CAST(k AS DOUBLE) / 100 AS candidate, t, CAST(k AS DOUBLE) / 100 AS p FROM sx, (SELECT unnest(generate_series(-10, 9)) AS k))"
CHOSEN_SQL = """, er AS (SELECT block, split, candidate, {metrics} FROM cand GROUP BY 1, 2, 3),
best AS (SELECT block, candidate FROM er WHERE split = 'val' QUALIFY row_number() OVER (PARTITION BY block ORDER BY mae, candidate) = 1)
SELECT er.block, er.split, CAST(er.candidate AS DOUBLE) AS candidate, n, {names} FROM er JOIN best ON er.block = best.block AND er.candidate = best.candidate"""
STATICS = [k / 100 for k in range(-10, 10)]


def _chosen(preds):
    keys = ["block", "split", "candidate"]
    errors = rounded_errors(preds, keys)
    best = ev.best_candidate(errors.filter("split = 'val'"), ["block"], "candidate", "mae").select("block", "candidate")
    return errors.join(best, ["block", "candidate"]).select(*keys, "n", *METRICS)


@query("q_baseline_avg", with_panels(SUPPLIER, body=TRUTH_SQL + AVG_SQL + CHOSEN_SQL.format(metrics=METRICS_SQL, names=", ".join(METRICS))))
def q_baseline_avg(spark, sf_dir):
    return _chosen(ev.candidate_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps", [1, 2, 3, 4], []))


@query("q_baseline_static", with_panels(SUPPLIER, body=TRUTH_SQL + STATIC_SQL + CHOSEN_SQL.format(metrics=METRICS_SQL, names=", ".join(METRICS))))
def q_baseline_static(spark, sf_dir):
    return _chosen(ev.candidate_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps", [], STATICS))


@query(
    "q_best_candidate",
    with_panels(
        SUPPLIER,
        body=TRUTH_SQL
        + AVG_SQL
        + """, er AS (SELECT block, candidate, round(avg(abs(p - t)), 6) AS mae FROM cand WHERE split = 'val' GROUP BY 1, 2)
SELECT block, CAST(arg_min(candidate, (mae, candidate)) AS DOUBLE) AS candidate, min(mae) AS mae FROM er GROUP BY 1""",
    ),
)
def q_best_candidate(spark, sf_dir):
    preds = ev.candidate_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps", [1, 2, 3, 4], []).filter("split = 'val'")
    errors = ev.errors_by(preds, ["block", "candidate"], ["mae"], digits=6)
    return ev.best_candidate(errors, ["block"], "candidate", "mae")


@query(
    "q_results_long",
    with_panels(
        SUPPLIER,
        body=TRUTH_SQL
        + """, er AS (SELECT block, split, round(avg(abs(x3 - t)), 6) AS mae, round(avg((x3 - t) * (x3 - t)), 6) AS mse FROM sx GROUP BY 1, 2)
SELECT block, split, 'mae' AS metric, mae AS value FROM er UNION ALL SELECT block, split, 'mse', mse FROM er""",
    ),
)
def q_results_long(spark, sf_dir):
    preds = ev.last_value_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps")
    return ev.errors_long(ev.errors_by(preds, ["block", "split"], ["mae", "mse"], digits=6).drop("n"), ["block", "split"], ["mae", "mse"])


@query("q_results_wide")
def q_results_wide(spark, sf_dir):
    preds = ev.last_value_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps")
    return ev.results_wide(ev.errors_by(preds, ["block", "split"], ["mae", "mse", "mda"], digits=6).drop("n"), ["mae", "mse", "mda"])


# The edges of the error histogram.
EDGES = [-2, -1.5, -1, -0.5, -0.25, -0.15, -0.1, -0.05, -0.025, -0.01, 0, 0.01, 0.025, 0.05, 0.1, 0.15, 0.25, 0.5, 1, 1.5, 2]
EDGE_ROWS = ", ".join(f"({i}, CAST({e} AS DOUBLE))" for i, e in enumerate(EDGES))


@query(
    "q_error_buckets",
    with_panels(
        SUPPLIER,
        body=TRUTH_SQL
        + f""", e AS (SELECT split, x3 - t AS e FROM sx), ed(i, v) AS (VALUES {EDGE_ROWS}),
pr AS (SELECT split, i, (count(CASE WHEN e < v THEN 1 END) + 0.5 * count(CASE WHEN e = v THEN 1 END)) * 100.0 / count(*) AS pct FROM e CROSS JOIN ed GROUP BY 1, 2)
SELECT split, CAST(b AS BIGINT) AS bucket, round(CAST(CASE WHEN b = 0 THEN lo.pct WHEN b = 21 THEN 100 - hi.pct ELSE lo.pct - hi.pct END AS DOUBLE), 6) AS percent
FROM (SELECT DISTINCT split FROM e) CROSS JOIN (SELECT unnest(generate_series(0, 21)) AS b)
LEFT JOIN pr lo USING (split) LEFT JOIN pr hi USING (split)
WHERE lo.i = least(b, 20) AND hi.i = greatest(b - 1, 0)""",
    ),
)
def q_error_buckets(spark, sf_dir):
    preds = ev.last_value_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps")
    return ev.error_histogram(preds, ["split"]).select("split", "bucket", F.round("percent", 6).alias("percent"))


@query(
    "q_weighted_error",
    with_panels(
        SUPPLIER,
        body="""
, r AS (SELECT comp, sales AS t, lag(sales) OVER w AS p, row_number() OVER w AS i FROM panel_supplier WINDOW w AS (PARTITION BY comp ORDER BY period)),
s AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY comp) AS n FROM r WHERE p IS NOT NULL),
w AS (SELECT comp, abs(p - t) / nullif(abs(t), 0) AS e, 1 - k * (2.0 / 3.0) / (n - 1) AS w FROM s)
SELECT comp, round(sum(e * w) / sum(w), 8) AS score FROM w GROUP BY 1""",
    ),
)
def q_weighted_error(spark, sf_dir):
    p = panel_supplier(spark, sf_dir).select(*KEYS, "sales", F.lag("sales").over(SPEC.ordered()).alias("guess")).filter(F.col("guess").isNotNull())
    return ev.weighted_relative_error(p, SPEC, "sales", "guess").withColumn("score", F.round("score", 8))


@query(
    "q_forecast_error_means",
    with_panels(
        SUPPLIER,
        body=TRUTH_SQL
        + """ SELECT split, round(avg(abs(x3 - t)), 6) AS mae, round(avg((x3 - t) * (x3 - t)), 6) AS mse,
  round(avg(CASE WHEN sign(t) = sign(x3) OR sign(round_even(t * 10000, 0)) = sign(round_even(x3 * 10000, 0)) THEN 1.0 ELSE 0.0 END), 6) AS mda,
  round(avg(sign(round_even(t * 1000000, 0))), 6) AS pos FROM sx GROUP BY 1""",
    ),
)
def q_forecast_error_means(spark, sf_dir):
    preds = ev.last_value_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps")
    out = ev.mean_forecast_errors(preds, ["split"])
    return out.select("split", *[F.round(c, 6).alias(c) for c in ("mae", "mse", "mda", "pos")])


@query(
    "q_append_splits",
    with_panels(SUPPLIER, body=TRUTH_SQL + " SELECT block, comp, t AS y_true, x3 AS y_pred FROM sx WHERE split IN ('val', 'test')"),
)
def q_append_splits(spark, sf_dir):
    """Out-of-sample = val and test appended."""
    preds = ev.last_value_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps").select("block", "split", "comp", "y_true", "y_pred")
    return preds.filter("split = 'val'").unionByName(preds.filter("split = 'test'")).drop("split")


@query(
    "q_align_results",
    with_panels(
        SUPPLIER,
        body=TRUTH_SQL
        + """, v AS (SELECT block, round(avg(abs(x3 - t)), 6) AS m FROM sx WHERE split = 'val' GROUP BY 1), s AS (SELECT block, round(avg(abs(x3 - t)), 6) AS m FROM sx WHERE split = 'test' GROUP BY 1)
SELECT block, v.m AS val, s.m AS test FROM v FULL JOIN s USING (block)""",
    ),
)
def q_align_results(spark, sf_dir):
    from panelweave.operators.link import align_results

    errors = ev.errors_by(ev.last_value_predictions(eps_samples(spark, sf_dir), "p_eps", "p_eps"), ["block", "split"], ["mae"], digits=6)
    return align_results({s: errors.filter(F.col("split") == s) for s in ("val", "test")}, "block", "mae")


@query(
    "q_split_lookup",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS data_year, CASE CAST(year(o_orderdate) AS BIGINT) WHEN 2000 THEN 'val' WHEN 2001 THEN 'test' END AS split, count(*) AS n
FROM orders GROUP BY 1, 2""",
)
def q_split_lookup(spark, sf_dir):
    from panelweave.operators.link import lookup

    years = load(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("data_year"))
    return lookup(years, "data_year", {2000: "val", 2001: "test"}, "split").groupBy("data_year", "split").agg(F.count(F.lit(1)).alias("n"))
