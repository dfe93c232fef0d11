"""The same panels for the SQL side of the result check: common table expressions over the raw tables."""

SUPPLIER = """
panel_supplier AS (
  SELECT f.comp, CAST(s.s_nationkey AS BIGINT) AS industry, CAST(n.n_regionkey AS BIGINT) AS sector,
         f.data_year, f.data_qrt, f.data_year * 100 + f.data_qrt AS period,
         f.sales, f.netincome, f.netincome / f.employeenum AS eps,
         (f.sales - f.netincome) / f.sales * 100 AS grossmargin,
         f.sga, f.inventory, f.capitalexpenditures, f.randd, f.orderbacklog, f.employeenum,
         f.disc_pct / f.employeenum / 100 - 0.05 AS fifovslifo
  FROM (
    SELECT l_suppkey AS comp, CAST(year(l_shipdate) AS BIGINT) AS data_year,
           CAST(quarter(l_shipdate) AS BIGINT) AS data_qrt,
           CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS sales,
           CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS netincome,
           CAST(sum(CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS sga,
           sum(l_quantity) AS inventory,
           CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) END) AS DOUBLE)
             AS capitalexpenditures,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) END) AS DOUBLE)
             AS randd,
           sum(CASE WHEN l_linestatus = 'O' AND l_discount > 0.08 THEN l_quantity END) AS orderbacklog,
           CAST(count(*) AS DOUBLE) AS employeenum,
           CAST(sum(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS disc_pct
    FROM lineitem GROUP BY 1, 2, 3) f
  JOIN supplier s ON f.comp = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)
"""

RATIOS = (
    SUPPLIER
    + """,
panel_ratios AS (
  SELECT p.*,
         sales + inventory * 100 AS totalassets,
         netincome - sga AS ebit,
         netincome - coalesce(capitalexpenditures, 0) AS leveredfocf,
         sales - sga AS wc,
         netincome - sales AS assetaccruals,
         sales / 100 AS depreciation,
         eps / 100 AS dividendperstock,
         grossmargin / 2 AS dividendyield,
         netincome / sales AS roe,
         netincome / (sales + inventory * 100) AS roa,
         netincome / sales * 100 AS netprofitmargin,
         sales / nullif(sga, 0) AS currentratio,
         (sales - inventory) / nullif(sga, 0) AS quickratio,
         netincome / nullif(inventory, 0) AS inventoryturnover,
         inventory / (sales + inventory * 100) AS inventorytoassets,
         capitalexpenditures / (sales + inventory * 100) AS capextoassets,
         randd / sales AS debttoequity,
         sales / (sales + inventory * 100) AS salestoassets,
         sales / (sales + inventory * 100) AS assetturnover,
         sales / employeenum AS acctrcvblturnover,
         (netincome - sga) / sales AS pretaxincometosales,
         sales / nullif(orderbacklog, 0) AS salestocash,
         (netincome - coalesce(capitalexpenditures, 0)) / nullif(randd, 0) AS fcftodebt,
         (sales - sga) / (sales + inventory * 100) AS wctoassets,
         (netincome - sga) / (sales + inventory * 100) AS opinctoassets,
         sga / nullif(randd, 0) AS ltdebtrepaypct,
         eps / nullif(netincome - coalesce(capitalexpenditures, 0), 0) AS divtofcf
  FROM panel_supplier p)
"""
)

CUSTOMER = """
panel_customer AS (
  SELECT c.c_custkey AS comp, c.c_mktsegment AS industry, cal.data_year, cal.data_qrt,
         cal.data_year * 100 + cal.data_qrt AS period, a.sales, a.n_orders,
         a.urgent / nullif(a.n_urgent, 0) AS urgent_avg
  FROM customer c
  CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS data_year,
                     CAST(quarter(o_orderdate) AS BIGINT) AS data_qrt FROM orders) cal
  LEFT JOIN (
    SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS data_year, CAST(quarter(o_orderdate) AS BIGINT) AS data_qrt,
           CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) AS sales, count(*) AS n_orders,
           CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
                         THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) END) AS DOUBLE) AS urgent,
           count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS n_urgent
    FROM orders GROUP BY 1, 2, 3) a
  ON a.o_custkey = c.c_custkey AND a.data_year = cal.data_year AND a.data_qrt = cal.data_qrt)
"""

EVENT = """
panel_event AS (
  SELECT user_id AS comp, user_id % 10 AS industry,
         CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS period,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END) AS DOUBLE) AS purchase,
         CAST(sum(CASE WHEN event_type = 'click' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END) AS DOUBLE) AS click,
         CAST(sum(CASE WHEN event_type = 'view' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END) AS DOUBLE) AS viewed,
         CAST(sum(CASE WHEN event_type = 'error' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END) AS DOUBLE) AS error,
         count(*) AS n_events
  FROM events GROUP BY 1, 2, 3)
"""


def with_panels(*panels: str, body: str) -> str:
    """A statement whose WITH list starts with the given panels; ``body`` adds entries with a leading comma."""
    text = body.strip()
    head = "WITH " + ",".join(panels)
    return head + "\n" + text
