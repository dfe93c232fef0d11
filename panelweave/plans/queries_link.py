"""Queries for linking, chunking, status tables and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import link as ln
from panelweave.plans.panel_sql import SUPPLIER, with_panels
from panelweave.plans.registry import query
from panelweave.plans.views import load, panel_supplier
from panelweave.sources.catalogue import split_properties
from panelweave.sources.requests import error_rows, latest_status, work_list
from panelweave.spec import q


@query(
    "q_fuzzy_match",
    """
WITH p AS (SELECT DISTINCT p.p_partkey, p.p_name, l.l_suppkey AS s_suppkey FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey),
s AS (SELECT p.*, u.s_name, 1 - CAST(levenshtein(p.p_name, u.s_name) AS DOUBLE) / greatest(length(p.p_name), length(u.s_name)) AS score
      FROM p LEFT JOIN supplier u ON p.s_suppkey = u.s_suppkey)
SELECT p_partkey, p_name, s_suppkey, s_name, round(score, 8) AS score, s_suppkey IS NOT NULL AS include_company FROM s
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC NULLS LAST, s_suppkey DESC) = 1""",
)
def q_fuzzy_match(spark, sf_dir):
    """Part -> the supplier, among those that delivered it, whose name is most similar."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_partkey").alias("link"))
    links = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("link"), F.col("l_suppkey").alias("s_suppkey"))
    out = ln.best_match(parts, links, load(spark, sf_dir, "supplier"), "p_partkey", "p_name", "link", "s_suppkey", "s_name")
    return out.withColumn("score", F.round("score", 8))


@query(
    "q_chained_lookup",
    """SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
)
def q_chained_lookup(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return ln.chained_lookup(c, "c_custkey", n, load(spark, sf_dir, "region"), "n_nationkey", "r_regionkey").select("c_custkey", "n_name", "r_name")


@query(
    "q_dict_lookup",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state FROM orders""",
)
def q_dict_lookup(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return ln.lookup(o, "o_orderstatus", {"F": "done", "O": "open"}, "state").select("o_orderkey", "state")


@query(
    "q_chunk_requests",
    """
WITH c AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 19 AS request_id FROM customer)
SELECT request_id, min(c_custkey) AS first_key, max(c_custkey) AS last_key, count(*) AS n, sum(c_custkey) AS key_sum FROM c GROUP BY 1""",
)
def q_chunk_requests(spark, sf_dir):
    """Requests of 19 customers: the size that a budget of 100,000 cells over 50 fields and 25 years allows."""
    size = ln.chunk_size(100_000, 50, 25)
    chunks = ln.chunk_entities(load(spark, sf_dir, "customer"), "c_custkey", size)
    keys = F.col("entities")
    total = F.aggregate(keys, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return chunks.select("request_id", F.array_min(keys).alias("first_key"), F.array_max(keys).alias("last_key"), "n", total.alias("key_sum"))


@query(
    "q_work_list",
    """
WITH c AS (SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 7 AS request_id FROM supplier)
SELECT request_id, '[' || string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) || ']' AS req_instruments, '["sales","eps"]' AS req_fields,
       CAST(0 AS INTEGER) AS status FROM c GROUP BY 1""",
)
def q_work_list(spark, sf_dir):
    return work_list(load(spark, sf_dir, "supplier"), "s_suppkey", 7, ["sales", "eps"]).select("request_id", "req_instruments", "req_fields", "status")


@query(
    "q_latest_status",
    """SELECT user_id AS request_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def q_latest_status(spark, sf_dir):
    out = latest_status(load(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return out.select(F.col("user_id").alias("request_id"), F.col("event_type").alias("status"), "event_id")


@query(
    "q_error_log",
    """
WITH e AS (SELECT event_id, event_type, CASE WHEN user_id < 50 THEN 'Backend error. The request could not be completed: ' || props ELSE 'Other: ' || props END AS m
           FROM events WHERE event_type = 'error')
SELECT event_id AS request_id, event_type AS error_type, CASE WHEN starts_with(m, 'Backend error') THEN substr(m, 1, 40) ELSE m END AS error_message FROM e""",
)
def q_error_log(spark, sf_dir):
    text = F.when(q("user_id") < 50, F.concat(F.lit("Backend error. The request could not be completed: "), q("props"))).otherwise(F.concat(F.lit("Other: "), q("props")))
    failed = load(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "event_type", text.alias("m"))
    return error_rows(failed, "event_id", "event_type", "m", ["Backend error"])


@query("q_lineage_tags", "SELECT o_orderkey, CAST(7 AS INTEGER) AS request_id, CAST(1 AS INTEGER) AS task_id, 'orders' AS report_type FROM orders")
def q_lineage_tags(spark, sf_dir):
    return ln.tag_lineage(load(spark, sf_dir, "orders").select("o_orderkey"), request_id=7, task_id=1, report_type="orders")


@query(
    "q_property_table",
    """
WITH x AS (SELECT o_custkey AS comp, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_orderpriority END AS b FROM orders)
SELECT comp, a AS o_orderstatus, b AS o_orderpriority FROM x
QUALIFY row_number() OVER (PARTITION BY comp ORDER BY (a IS NOT NULL)::INT + (b IS NOT NULL)::INT DESC, a NULLS FIRST, b NULLS FIRST) = 1""",
)
def q_property_table(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("comp"),
        F.when(q("o_orderstatus") != "P", q("o_orderstatus")).alias("o_orderstatus"),
        F.when(q("o_totalprice") <= 200000, q("o_orderpriority")).alias("o_orderpriority"),
        "o_totalprice",
    )
    props, _ = split_properties(o, ["o_orderstatus", "o_orderpriority"], ["comp"], "comp")
    return props


@query(
    "q_collapse_ties",
    """
WITH s AS (SELECT s_suppkey, s_name, s_nationkey, round(1 - CAST(levenshtein(s_name, n_name) AS DOUBLE) / greatest(length(s_name), length(n_name)), 8) AS score
           FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT score, max(s_suppkey) AS s_suppkey, max(s_name) AS s_name, max(s_nationkey) AS s_nationkey FROM s GROUP BY 1""",
)
def q_collapse_ties(spark, sf_dir):
    from panelweave.functions.scalars import name_similarity

    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    scored = load(spark, sf_dir, "supplier").join(n, "s_nationkey")
    score = F.round(name_similarity(q("s_name"), q("n_name")), 8)
    return ln.collapse_ties(scored.select(score.alias("score"), "s_suppkey", "s_name", "s_nationkey"), "score")


@query("q_table_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def q_table_scan(spark, sf_dir):
    from panelweave.plans.views import SPEC
    from panelweave.sources.catalogue import Dataset, Registry
    from panelweave.sources.tables import text_as_string

    registry = Registry({"suppliers": Dataset(f"{sf_dir}/supplier.parquet", SPEC, "s_acctbal")})
    return text_as_string(registry.scan(spark, "suppliers"))


@query("q_sql_text", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def q_sql_text(spark, sf_dir):
    from panelweave.sources.tables import read_sql

    views = {n: load(spark, sf_dir, n) for n in ("region", "nation", "supplier")}
    return read_sql(spark, "SELECT r_name, count(*) AS n FROM {region} JOIN {nation} ON r_regionkey = n_regionkey JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY r_name", **views)


@query(
    "q_best_run",
    """
WITH r AS (SELECT o_custkey AS run_id, o_orderpriority AS name, o_orderstatus AS block, o_totalprice AS loss, o_orderkey AS logged FROM orders)
SELECT name, block, run_id, loss FROM r QUALIFY row_number() OVER (PARTITION BY name, block ORDER BY loss, logged) = 1""",
)
def q_best_run(spark, sf_dir):
    from panelweave.plans.runs import best_runs

    runs = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("block"), F.col("o_totalprice").alias("loss"), F.col("o_orderkey").alias("logged")
    )
    return best_runs(runs, ["name", "block"], "loss", "logged").select("name", "block", "run_id", "loss")


@query("q_company_listing", with_panels(SUPPLIER, body="SELECT period, count(DISTINCT comp) AS companies, min(comp) AS first_comp, max(comp) AS last_comp FROM panel_supplier GROUP BY 1"))
def q_company_listing(spark, sf_dir):
    p = panel_supplier(spark, sf_dir)
    return p.groupBy("period").agg(F.count_distinct("comp").alias("companies"), F.min("comp").alias("first_comp"), F.max("comp").alias("last_comp"))
