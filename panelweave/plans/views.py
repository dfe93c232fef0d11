"""Panels over the synthetic tables.

Money is held in whole cents (as DOUBLE), so sums are exact whatever order the partial sums merge in.
Every panel aggregates the raw rows by (entity, period) first - with map-side combine, so a hot entity costs
one partial row per task - and joins the small dimensions afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.scalars import period_key, ratio
from panelweave.spec import PanelSpec

SPEC = PanelSpec()
SECTOR_SPEC = PanelSpec(industry="sector")

SUPPLIER_MEASURES = [
    "sales", "netincome", "eps", "grossmargin", "sga", "inventory", "capitalexpenditures", "randd",
    "orderbacklog", "employeenum", "fifovslifo",
]
EVENT_MEASURES = ["purchase", "click", "viewed", "error"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5)


def panel_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    facts = (
        li.groupBy(
            F.col("l_suppkey").alias("comp"),
            F.year("l_shipdate").cast("bigint").alias("data_year"),
            F.quarter("l_shipdate").cast("bigint").alias("data_qrt"),
        )
        .agg(
            F.sum(cents(price)).cast("double").alias("sales"),
            F.sum(cents(price * (1 - disc))).cast("double").alias("netincome"),
            F.sum(cents(price * F.col("l_tax"))).cast("double").alias("sga"),
            F.sum("l_quantity").alias("inventory"),
            F.sum(F.when(F.col("l_returnflag") == "A", cents(price))).cast("double").alias("capitalexpenditures"),
            F.sum(F.when(F.col("l_returnflag") == "R", cents(price))).cast("double").alias("randd"),
            F.sum(F.when((F.col("l_linestatus") == "O") & (disc > 0.08), F.col("l_quantity"))).alias("orderbacklog"),
            F.count(F.lit(1)).cast("double").alias("employeenum"),
            F.sum(cents(disc)).cast("double").alias("disc_pct"),
        )
    )
    supplier = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("comp"), F.col("s_nationkey").cast("bigint").alias("industry")
    )
    nation = load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("industry"), F.col("n_regionkey").cast("bigint").alias("sector")
    )
    sales, net = F.col("sales"), F.col("netincome")
    return facts.join(supplier, "comp").join(nation, "industry").select(
        "comp",
        "industry",
        "sector",
        "data_year",
        "data_qrt",
        period_key(F.col("data_year"), F.col("data_qrt")).alias("period"),
        "sales",
        "netincome",
        (net / F.col("employeenum")).alias("eps"),
        (ratio(sales - net, sales) * 100).alias("grossmargin"),
        "sga",
        "inventory",
        "capitalexpenditures",
        "randd",
        "orderbacklog",
        "employeenum",
        (F.col("disc_pct") / F.col("employeenum") / 100 - 0.05).alias("fifovslifo"),
    )


def panel_supplier_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier panel plus a proxy for every measure the named feature sets use."""
    p = panel_supplier(spark, sf_dir)
    c = F.col
    assets = c("sales") + c("inventory") * 100
    ebit = c("netincome") - c("sga")
    fcf = c("netincome") - F.coalesce(c("capitalexpenditures"), F.lit(0.0))
    wc = c("sales") - c("sga")
    return p.select(
        "*",
        assets.alias("totalassets"),
        ebit.alias("ebit"),
        fcf.alias("leveredfocf"),
        wc.alias("wc"),
        (c("netincome") - c("sales")).alias("assetaccruals"),
        (c("sales") / 100).alias("depreciation"),
        (c("eps") / 100).alias("dividendperstock"),
        (c("grossmargin") / 2).alias("dividendyield"),
        ratio(c("netincome"), c("sales")).alias("roe"),
        ratio(c("netincome"), assets).alias("roa"),
        (ratio(c("netincome"), c("sales")) * 100).alias("netprofitmargin"),
        ratio(c("sales"), c("sga")).alias("currentratio"),
        ratio(c("sales") - c("inventory"), c("sga")).alias("quickratio"),
        ratio(c("netincome"), c("inventory")).alias("inventoryturnover"),
        ratio(c("inventory"), assets).alias("inventorytoassets"),
        ratio(c("capitalexpenditures"), assets).alias("capextoassets"),
        ratio(c("randd"), c("sales")).alias("debttoequity"),
        ratio(c("sales"), assets).alias("salestoassets"),
        ratio(c("sales"), assets).alias("assetturnover"),
        ratio(c("sales"), c("employeenum")).alias("acctrcvblturnover"),
        ratio(ebit, c("sales")).alias("pretaxincometosales"),
        ratio(c("sales"), c("orderbacklog")).alias("salestocash"),
        ratio(fcf, c("randd")).alias("fcftodebt"),
        ratio(wc, assets).alias("wctoassets"),
        ratio(ebit, assets).alias("opinctoassets"),
        ratio(c("sga"), c("randd")).alias("ltdebtrepaypct"),
        ratio(c("eps"), fcf).alias("divtofcf"),
    )


def panel_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer in every quarter that has orders; quarters without an order of theirs stay empty.

    A customer's quarters travel as one map, no longer than the calendar, and the calendar unfolds after the join: Spark takes
    an exploded side to be as small as before it and would broadcast the whole grid. Rows stay dealt by customer, over all
    shuffle partitions, since partitions merged by their size before the calendar unfolds would be far too large after it.
    """
    total = F.col("o_totalprice")
    facts = (
        load(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_custkey").alias("comp"),
            period_key(F.year("o_orderdate"), F.quarter("o_orderdate")).alias("period"),
        )
        .agg(
            F.sum(cents(total)).cast("double").alias("sales"),
            F.count(F.lit(1)).alias("n_orders"),
            F.sum(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), cents(total))).cast("double").alias("urgent"),
            F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("n_urgent"),
        )
    )
    calendar = (
        load(spark, sf_dir, "orders")
        .agg(F.array_sort(F.collect_set(period_key(F.year("o_orderdate"), F.quarter("o_orderdate")))))
        .scalar()
    )
    measures = F.struct("sales", "n_orders", F.try_divide("urgent", "n_urgent").alias("urgent_avg"))
    series = (
        facts.filter(F.col("period").isNotNull())
        .groupBy("comp")
        .agg(F.map_from_entries(F.collect_list(F.struct("period", measures.alias("m")))).alias("held"))
    )
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("comp"), F.col("c_mktsegment").alias("industry"))
    customer = customer.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "comp")
    grid = customer.join(series, "comp", "left").select("comp", "industry", "held", F.explode(calendar).alias("period"))
    return grid.withColumn("m", F.try_element_at("held", "period")).select(
        "comp",
        "industry",
        F.floor(F.col("period") / 100).alias("data_year"),
        (F.col("period") % 100).alias("data_qrt"),
        "period",
        "m.sales",
        "m.n_orders",
        "m.urgent_avg",
    )


def panel_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day (period = yyyymmdd); users fall into ten groups."""
    day = F.year("ts").cast("bigint") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")
    value = cents(F.col("value"))

    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("event_type") == kind, value)).cast("double")

    return (
        load(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("comp"), (F.col("user_id") % 10).alias("industry"), day.alias("period"))
        .agg(
            total("purchase").alias("purchase"),
            total("click").alias("click"),
            total("view").alias("viewed"),
            total("error").alias("error"),
            F.count(F.lit(1)).alias("n_events"),
        )
    )
