"""Queries for group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import groups as g
from panelweave.plans.panel_sql import CUSTOMER, EVENT, SUPPLIER, with_panels
from panelweave.plans.queries_ordered import EMPTY_SERIES_SQL
from panelweave.plans.registry import query
from panelweave.plans.views import EVENT_MEASURES, SECTOR_SPEC, SPEC, panel_customer, panel_event, panel_supplier
from panelweave.spec import q

KEYS = ["comp", "period"]


@query(
    "q_industry_mean",
    with_panels(
        SUPPLIER,
        body="SELECT industry, period, round(avg(sales), 3) AS sales, round(avg(eps), 3) AS eps, round(avg(randd), 3) AS randd FROM panel_supplier GROUP BY 1, 2",
    ),
)
def q_industry_mean(spark, sf_dir):
    cols = ["sales", "eps", "randd"]
    out = g.group_mean(panel_supplier(spark, sf_dir), ["industry", "period"], cols)
    return out.select("industry", "period", *[F.round(c, 3).alias(c) for c in cols])


@query(
    "q_group_levels",
    with_panels(
        SUPPLIER,
        body="""
SELECT 'period' AS level, period, CAST(NULL AS BIGINT) AS sector, round(avg(sales), 2) AS sales_mean, round(stddev_samp(sales), 2) AS sales_std,
       count(sales) AS sales_count, round(avg(orderbacklog), 4) AS orderbacklog_mean, round(stddev_samp(orderbacklog), 4) AS orderbacklog_std,
       count(orderbacklog) AS orderbacklog_count
FROM panel_supplier GROUP BY period
UNION ALL
SELECT 'industry', period, sector, round(avg(sales), 2), round(stddev_samp(sales), 2), count(sales), round(avg(orderbacklog), 4),
       round(stddev_samp(orderbacklog), 4), count(orderbacklog)
FROM panel_supplier GROUP BY period, sector""",
    ),
)
def q_group_levels(spark, sf_dir):
    out = g.group_levels(panel_supplier(spark, sf_dir), SECTOR_SPEC, ["sales", "orderbacklog"])
    digits = {"sales": 2, "orderbacklog": 4}
    return out.select(
        "level",
        "period",
        "sector",
        *[F.round(f"{c}_{k}", d).alias(f"{c}_{k}") for c, d in digits.items() for k in ("mean", "std")],
        *[f"{c}_count" for c in digits],
    )


@query("q_industry_blend", with_panels(EVENT, body=EMPTY_SERIES_SQL + "SELECT industry, period, round(blend, 4) AS error FROM blend"))
def q_industry_blend(spark, sf_dir):
    out = g.group_blend(panel_event(spark, sf_dir), SPEC, ["error"])
    return out.withColumn("error", F.round("error", 4))


@query(
    "q_industry_compare",
    with_panels(
        SUPPLIER,
        body="""
, m AS (SELECT sector, period, avg(sales) AS a, avg(orderbacklog) AS b FROM panel_supplier GROUP BY 1, 2)
SELECT p.comp, p.sector, p.period, CAST(coalesce(p.sales >= a, false) AS BIGINT) AS sales,
       CAST(coalesce(p.orderbacklog >= b, false) AS BIGINT) AS orderbacklog
FROM panel_supplier p JOIN m ON p.sector = m.sector AND p.period = m.period""",
    ),
)
def q_industry_compare(spark, sf_dir):
    return g.compare_to_group(panel_supplier(spark, sf_dir), SECTOR_SPEC, ["sales", "orderbacklog"])


@query(
    "q_attach_group_mean",
    with_panels(
        SUPPLIER,
        body="""
, m AS (SELECT sector, period, avg(capitalexpenditures) AS a FROM panel_supplier GROUP BY 1, 2)
SELECT p.comp, p.period, round(a, 3) AS capitalexpenditures_avg FROM panel_supplier p LEFT JOIN m ON p.sector = m.sector AND p.period = m.period""",
    ),
)
def q_attach_group_mean(spark, sf_dir):
    out = g.attach_group_mean(panel_supplier(spark, sf_dir), SECTOR_SPEC, ["capitalexpenditures"])
    return out.select(*KEYS, F.round("capitalexpenditures_avg", 3).alias("capitalexpenditures_avg"))


@query(
    "q_group_change",
    with_panels(
        SUPPLIER,
        body="""
, m AS (SELECT sector, period, avg(sales) AS a FROM panel_supplier GROUP BY 1, 2)
SELECT sector, period, round(a / nullif(lag(a) OVER (PARTITION BY sector ORDER BY period), 0) - 1, 8) AS sales_change FROM m""",
    ),
)
def q_group_change(spark, sf_dir):
    return g.group_change(panel_supplier(spark, sf_dir), SECTOR_SPEC, ["sales"]).withColumn("sales_change", F.round("sales_change", 8))


@query(
    "q_median_counts",
    with_panels(
        EVENT,
        body="""
, c AS (SELECT period, count(purchase) AS a, count(click) AS b, count(viewed) AS c, count(error) AS d FROM panel_event GROUP BY 1)
SELECT median(a) AS purchase, median(b) AS click, median(c) AS viewed, median(d) AS error FROM c""",
    ),
)
def q_median_counts(spark, sf_dir):
    return g.median_count_per_period(panel_event(spark, sf_dir), SPEC, EVENT_MEASURES)


@query(
    "q_asof_broadcast",
    with_panels(
        CUSTOMER,
        body="""
, st AS (SELECT period, count(urgent_avg) AS n_urgent, max(urgent_avg) AS top_urgent FROM panel_customer
         WHERE data_qrt IN (1, 3) GROUP BY 1),
g AS (SELECT industry, period, count(sales) AS n_sales FROM panel_customer GROUP BY 1, 2)
SELECT g.industry, g.period, g.n_sales, st.n_urgent, st.top_urgent
FROM g ASOF LEFT JOIN st ON g.period >= st.period""",
    ),
)
def q_asof_broadcast(spark, sf_dir):
    p = panel_customer(spark, sf_dir)
    stats = p.filter(F.col("data_qrt").isin(1, 3)).groupBy("period").agg(F.count("urgent_avg").alias("n_urgent"), F.max("urgent_avg").alias("top_urgent"))
    groups = p.groupBy("industry", "period").agg(F.count("sales").alias("n_sales"))
    known = g.asof_lookup(groups, stats, "period", ["n_urgent", "top_urgent"])
    return groups.join(known, "period", "left")


@query(
    "q_yearly_reduce",
    with_panels(
        SUPPLIER,
        body="""
, l AS (SELECT *, lag(eps) OVER (PARTITION BY comp ORDER BY period) AS lg FROM panel_supplier),
s AS (SELECT comp, data_qrt, stddev_samp(lg) AS sd FROM l GROUP BY 1, 2),
b AS (SELECT comp, data_qrt FROM s WHERE sd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY comp ORDER BY sd DESC, data_qrt DESC) = 1)
SELECT l.comp, l.data_year, CAST(0 AS BIGINT) AS data_qrt, l.period, l.eps, l.sales FROM l JOIN b ON l.comp = b.comp AND l.data_qrt = b.data_qrt""",
    ),
)
def q_yearly_reduce(spark, sf_dir):
    out = g.reduce_to_yearly(panel_supplier(spark, sf_dir), SPEC, "eps", "data_year", "data_qrt")
    return out.select("comp", "data_year", "data_qrt", "period", "eps", "sales")


@query("q_group_max", with_panels(SUPPLIER, body="SELECT industry, max(sales) AS sales, max(eps) AS eps, max(period) AS period FROM panel_supplier GROUP BY 1"))
def q_group_max(spark, sf_dir):
    return g.group_max(panel_supplier(spark, sf_dir), ["industry"], ["sales", "eps", "period"])


@query("q_content_hash")
def q_content_hash(spark, sf_dir):
    """Order-insensitive hash of a table: the sum of row hashes (exact decimal, so it cannot overflow)."""
    p = panel_supplier(spark, sf_dir)
    row = F.xxhash64(*[q(c) for c in p.columns]).cast("decimal(38,0)")
    return p.agg(F.sum(row).cast("string").alias("content_hash"), F.count(F.lit(1)).alias("n"))


@query(
    "q_content_digest",
    with_panels(
        SUPPLIER,
        body="""SELECT CAST(sum(CAST('0x' || substr(md5(concat_ws('|', comp, industry, period, CAST(sales AS BIGINT), CAST(employeenum AS BIGINT))), 1, 15) AS HUGEINT)) AS VARCHAR) AS content_digest, count(*) AS n FROM panel_supplier""",
    ),
)
def q_content_digest(spark, sf_dir):
    """The same by MD5, which other engines compute alike: the sum of 60 bits of each row's digest."""
    p = panel_supplier(spark, sf_dir)
    row = F.md5(F.concat_ws("|", *[q(c).cast("string") for c in ("comp", "industry", "period")], *[q(c).cast("bigint").cast("string") for c in ("sales", "employeenum")]).cast("binary"))
    return p.agg(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("content_digest"), F.count(F.lit(1)).alias("n"))
