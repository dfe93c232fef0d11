"""Baselines, error tables, histograms and the choice of the best candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.metrics import ERROR_EDGES, ERROR_METRICS, error_bucket, error_table
from panelweave.spec import PanelSpec, q


def last_average(x: Column, feature: str, periods: int) -> Column:
    """Mean of the last ``periods`` input steps of a sample array."""
    tail = F.transform(F.slice(x, -periods, periods), lambda s: s[feature].cast("double"))
    return F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / periods


def candidate_predictions(samples: DataFrame, feature: str, target: str, averages: Sequence[int], statics: Sequence[float]) -> DataFrame:
    """(keys, model, candidate, y_true, y_pred): every sample under every baseline candidate, in one pass."""
    keys = [c for c in samples.columns if c not in ("x", "y")]
    entries = [F.struct(F.lit("avg").alias("model"), F.lit(float(n)).alias("candidate"), last_average(F.col("x"), feature, n).alias("y_pred")) for n in averages]
    entries += [F.struct(F.lit("static").alias("model"), F.lit(float(v)).alias("candidate"), F.lit(float(v)).alias("y_pred")) for v in statics]
    y = F.element_at("y", 1)[target].cast("double").alias("y_true")
    return samples.select(*keys, y, F.explode(F.array(*entries)).alias("e")).select(*keys, "y_true", "e.*")


def last_value_predictions(samples: DataFrame, feature: str, target: str) -> DataFrame:
    keys = [c for c in samples.columns if c not in ("x", "y")]
    y = F.element_at("y", 1)[target].cast("double").alias("y_true")
    return samples.select(*keys, y, last_average(F.col("x"), feature, 1).alias("y_pred"))


def errors_by(preds: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """Error metrics per key, one column per metric."""
    cols = error_table(F.col("y_true"), F.col("y_pred"), tuple(names or ERROR_METRICS), digits)
    return preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *cols)


def errors_long(errors: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, metric, value)."""
    return errors.unpivot(list(keys), list(names), "metric", "value")


def best_candidate(errors: DataFrame, keys: Sequence[str], candidate: str, loss: str) -> DataFrame:
    """Per key the candidate with the least loss; ties go to the smallest candidate."""
    order = F.struct(q(loss), q(candidate))
    return errors.groupBy(*keys).agg(F.min_by(q(candidate), order).alias(candidate), F.min(q(loss)).alias(loss))


def error_histogram(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percent of errors per fixed bucket; values on an edge count half to either side.

    One aggregate by bucket number; the split of the edge values works on the handful of counts.
    """
    e = F.col("y_pred") - F.col("y_true")
    counts = preds.groupBy(*keys, error_bucket(e).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    edges = [float("-inf"), *ERROR_EDGES, float("inf")]
    bucket = F.floor(F.col("code") / 2)
    on_edge = F.col("code") % 2 == 1
    halves = F.when(on_edge, F.array(F.struct(bucket.alias("b"), (F.col("n") / 2).alias("w")), F.struct((bucket + 1).alias("b"), (F.col("n") / 2).alias("w")))).otherwise(
        F.array(F.struct(bucket.alias("b"), F.col("n").cast("double").alias("w")))
    )
    spread = counts.select(*keys, F.explode(halves).alias("h")).groupBy(*keys, F.col("h.b").alias("bucket")).agg(F.sum("h.w").alias("w"))
    # Every key shows all buckets; the weights are exact halves, so their sum is the number of rows.
    totals = spread.groupBy(*keys).agg(F.sum("w").alias("total"), F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    grid = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(edges) - 2).cast("bigint")))
    each = totals.select(*keys, "total", "m", grid.alias("bucket"))
    names = F.array(*[F.lit(f"{a:g}..{b:g}") for a, b in zip(edges, edges[1:])])
    return each.select(
        *keys,
        "bucket",
        F.element_at(names, F.col("bucket").cast("int") + 1).alias("error_range"),
        (F.coalesce(F.try_element_at("m", F.col("bucket")), F.lit(0.0)) * 100 / F.col("total")).alias("percent"),
    )


def weighted_relative_error(df: DataFrame, spec: PanelSpec, t: str, p: str, alias: str = "score") -> DataFrame:
    """Per entity: relative error weighted linearly from 1 (first row) down to 1/3 (last row)."""
    w = spec.ordered()
    rows = df.select(spec.comp, q(t).alias("t"), q(p).alias("p"), (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(spec.whole()).alias("n"))
    weight = F.lit(1.0) - F.col("i") * F.try_divide(F.lit(2.0 / 3.0), F.col("n") - 1)
    err = F.try_divide(F.abs(F.col("p") - F.col("t")), F.abs(F.col("t")))
    return rows.groupBy(spec.comp).agg(F.try_divide(F.sum(err * weight), F.sum(weight)).alias(alias))


def split_statistics(samples: DataFrame, spec: PanelSpec, n_features: int) -> DataFrame:
    """Data card per block and split: samples, entities, features, windows, first and last period.

    Distinct entities and windows come from two-step aggregation (distinct first), so no set is ever built in one task.
    """
    return samples.groupBy("block", "split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct(q(spec.comp)).alias("companies"),
        F.lit(n_features).cast("bigint").alias("features"),
        F.count_distinct("start").alias("time_steps"),
        F.min("lower").alias("time_min"),
        F.max("upper").alias("time_max"),
    )


def results_wide(errors: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric x block_split table from (block, split, metrics...). Blocks are few; they become columns."""
    long = errors_long(errors.withColumn("block_split", F.concat_ws("_", "block", "split")), ["block_split"], metrics)
    return long.groupBy("metric").pivot("block_split").agg(F.first("value"))


def mean_forecast_errors(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the per-entity errors (mae, mse, fine directional accuracy, sign of the truth)."""
    t, p = F.col("y_true"), F.col("y_pred")
    hit = (F.signum(t) == F.signum(p)) | (F.signum(F.rint(t * 10000)) == F.signum(F.rint(p * 10000)))
    return preds.groupBy(*keys).agg(
        F.avg(F.abs(p - t)).alias("mae"),
        F.avg((p - t) * (p - t)).alias("mse"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("mda"),
        F.avg(F.signum(F.rint(t * 1000000))).alias("pos"),
    )
