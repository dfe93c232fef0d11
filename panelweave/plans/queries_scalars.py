"""Queries for the scalar functions and the row-local sink and fingerprint rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import scalars as s
from panelweave.operators.select import levels, one_hot
from panelweave.plans.registry import query
from panelweave.plans.views import load
from panelweave.spec import q


@query(
    "q_text_to_double",
    """
WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN '   ' WHEN 'error' THEN '-Infinity' WHEN 'click' THEN CAST(user_id AS VARCHAR)
                                            WHEN 'purchase' THEN CAST(user_id AS VARCHAR) || 'x' ELSE 'NaN' END AS raw FROM events)
SELECT event_id, CASE WHEN regexp_matches(raw, '^\\s*$') OR raw IN ('NaN', 'Infinity', '-Infinity') THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS amount FROM t""",
)
def q_text_to_double(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    raw = F.when(kind == "view", "   ").when(kind == "error", "-Infinity").when(kind == "click", user).when(kind == "purchase", F.concat(user, F.lit("x"))).otherwise("NaN")
    return load(spark, sf_dir, "events").select("event_id", s.text_to_double(raw).alias("amount"))


@query(
    "q_infinities",
    """
WITH t AS (SELECT l_returnflag, exp(l_quantity * 20) AS x, l_quantity AS v FROM lineitem)
SELECT l_returnflag, count(*) AS n, count(CASE WHEN isfinite(x) THEN 1 END) AS n_finite,
       sum(CASE WHEN isfinite(x) THEN v ELSE 0 END) AS kept FROM t GROUP BY 1""",
)
def q_infinities(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    x = s.finite(F.exp(F.col("l_quantity") * 20))
    kept = F.when(s.zero_if_missing(x) != 0, F.col("l_quantity")).otherwise(0.0)
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("n_finite"), F.sum(kept).alias("kept"))


@query("q_key_not_blank", "SELECT p_partkey, p_name FROM part WHERE p_name IS NOT NULL AND trim(p_name) <> ''")
def q_key_not_blank(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.filter(s.not_blank(q("p_name"))).select("p_partkey", "p_name")


@query(
    "q_scalar_text",
    """
SELECT p_partkey, split_part(p_brand, '#', 1) AS brand_head, split_part(p_name, ' ', 1) AS name_head, lower(p_type) AS type_lower,
       upper(p_name) AS name_upper, replace(p_brand, '#', '_') AS brand_safe, starts_with(p_type, 'EC') AS is_ec,
       regexp_matches(p_name, '^\\s*$') AS is_blank,
       levenshtein(p_name, p_type) AS distance,
       round(1 - CAST(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type)), 8) AS similarity
FROM part""",
)
def q_scalar_text(spark, sf_dir):
    name, kind, brand = q("p_name"), q("p_type"), q("p_brand")
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        s.before(brand, "#").alias("brand_head"),
        s.before(name, " ").alias("name_head"),
        F.lower(kind).alias("type_lower"),
        F.upper(name).alias("name_upper"),
        F.replace(brand, F.lit("#"), F.lit("_")).alias("brand_safe"),
        kind.startswith("EC").alias("is_ec"),
        name.rlike(r"^\s*$").alias("is_blank"),
        F.levenshtein(name, kind).cast("bigint").alias("distance"),
        F.round(s.name_similarity(name, kind), 8).alias("similarity"),
    )


@query(
    "q_scalar_dates",
    """
WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
                  CAST(quarter(o_orderdate) AS BIGINT) AS qt FROM orders)
SELECT o_orderkey, CAST(substr(d, 1, 4) AS BIGINT) AS y, CAST(substr(d, 6, 2) AS BIGINT) AS m, CAST(substr(d, 9, 2) AS BIGINT) AS dd,
       y * 100 + qt AS period, CAST(lpad(CAST(y AS VARCHAR), 4, '0') || lpad(CAST(qt AS VARCHAR), 2, '0') AS BIGINT) AS period_text,
       m // 3 AS fiscal_qrt, (y - 1950) * 4 + qt AS linear_id, y + CAST(qt AS DOUBLE) / 4 AS fractional_year,
       epoch(CAST(d AS TIMESTAMP)) AS seconds
FROM t""",
)
def q_scalar_dates(spark, sf_dir):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    t = load(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), F.year("o_orderdate").alias("yy"), F.quarter("o_orderdate").alias("qt"))
    y, m, qt = s.date_part(q("d"), "year"), s.date_part(q("d"), "month"), q("qt")
    period = s.period_key(y, qt)
    return t.select(
        "o_orderkey",
        y.alias("y"),
        m.alias("m"),
        s.date_part(q("d"), "day").alias("dd"),
        period.alias("period"),
        s.period_key_text(q("yy"), qt).alias("period_text"),
        s.fiscal_quarter(m).alias("fiscal_qrt"),
        s.linear_period(y, qt).alias("linear_id"),
        s.fractional_year(period).alias("fractional_year"),
        F.unix_seconds(F.to_timestamp(F.concat(q("d"), F.lit("T00:00:00Z")))).cast("double").alias("seconds"),
    )


@query(
    "q_scalar_math",
    """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount - 0.05 AS x, l_quantity AS v, l_tax AS tax FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, abs(x) AS ax, CAST(sign(round(x, 6)) AS DOUBLE) AS sx, round(1 / (1 + exp(-x)), 8) AS logi,
       least(1.0, v / 10) AS clipped, round(ln(1 + v), 8) AS lg, sqrt(v) AS root, CAST(round_even(v / 4, 0) AS DOUBLE) AS half_even,
       v / nullif(tax, 0) AS safe_ratio, CASE WHEN x < 0 THEN 1 ELSE 0 END AS negative FROM t""",
)
def q_scalar_math(spark, sf_dir):
    x, v = q("l_discount") - 0.05, q("l_quantity")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.abs(x).alias("ax"),
        F.signum(F.round(x, 6)).alias("sx"),
        F.round(s.logistic(x), 8).alias("logi"),
        F.least(F.lit(1.0), v / 10).alias("clipped"),
        F.round(F.log1p(v), 8).alias("lg"),
        F.sqrt(v).alias("root"),
        F.rint(v / 4).alias("half_even"),
        s.ratio(v, q("l_tax")).alias("safe_ratio"),
        s.negative_flag(x).alias("negative"),
    )


@query(
    "q_literal_json",
    """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len([event_type, 'x']) AS n_items,
       event_type AS first_item, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS as_json FROM events""",
)
def q_literal_json(spark, sf_dir):
    listed = F.concat(F.lit("['"), q("event_type"), F.lit("', 'x']"))
    arr = s.literal_to_array(listed)
    return load(spark, sf_dir, "events").select(
        "event_id",
        s.literal_to_map(q("props"), "bigint")["k"].alias("k"),
        F.size(arr).cast("bigint").alias("n_items"),
        arr[0].alias("first_item"),
        F.to_json(F.struct("event_type", "user_id")).alias("as_json"),
    )


@query(
    "q_one_hot",
    """
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS "c_mktsegment_BUILDING", CAST(c_mktsegment = 'FURNITURE' AS BIGINT) AS "c_mktsegment_FURNITURE",
       CAST(c_mktsegment = 'HOUSEHOLD' AS BIGINT) AS "c_mktsegment_HOUSEHOLD", CAST(c_mktsegment = 'MACHINERY' AS BIGINT) AS "c_mktsegment_MACHINERY",
       CAST(c_mktsegment IS NULL AS BIGINT) AS c_mktsegment_nan FROM customer""",
)
def q_one_hot(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return one_hot(c, levels(c, ["c_mktsegment"]), ["c_custkey"])


@query("q_typed_columns", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, value FROM events")
def q_typed_columns(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id", q("user_id").cast("string").alias("user_id"), "event_type", F.to_date("ts").cast("string").alias("day"), "value"
    )


@query(
    "q_sink_rows",
    "SELECT event_id, nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS event_type, CASE WHEN value > 50 THEN NULL ELSE value END AS value FROM events",
)
def q_sink_rows(spark, sf_dir):
    """Rows as the append sink writes them: blank text, NaN and infinity become NULL."""
    from panelweave.sources.tables import null_normalised

    e = load(spark, sf_dir, "events").select(
        "event_id",
        F.when(q("event_type") == "view", "").otherwise(q("event_type")).alias("event_type"),
        F.when(q("value") > 50, float("nan")).otherwise(q("value")).alias("value"),
    )
    return null_normalised(e)


@query(
    "q_fingerprint",
    "SELECT p_partkey, substr(sha256(p_brand || '/' || p_type || '/' || p_size), 1, 10) AS fingerprint FROM part",
)
def q_fingerprint(spark, sf_dir):
    from panelweave.sources.tables import fingerprint_column

    return load(spark, sf_dir, "part").select("p_partkey", fingerprint_column("p_brand", "p_type", "p_size").alias("fingerprint"))
