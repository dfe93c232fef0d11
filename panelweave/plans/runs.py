"""Run log: one row per run, append-only, and lookups over it."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.tables import append, fingerprint
from panelweave.spec import q

RUN_SCHEMA = "run_id string, name string, block string, params string, tags string, metrics map<string,double>, at timestamp"


def log_run(
    spark: SparkSession, path: str, name: str, block: str, params: Mapping[str, object], metrics: Mapping[str, float], tags: Mapping[str, str] | None = None
) -> str:
    """Append one run; its id is the fingerprint of name, block and parameters."""
    run_id = fingerprint(name=name, block=block, params=dict(params))
    row = [(run_id, name, block, json.dumps(dict(params), sort_keys=True, default=str), json.dumps(dict(tags or {}), sort_keys=True), {k: float(v) for k, v in metrics.items()})]
    cols = RUN_SCHEMA.rsplit(", at", 1)[0]
    append(spark.createDataFrame(row, cols).withColumn("at", F.current_timestamp()), path)
    return run_id


def read_runs(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """All runs with one metric as the column ``loss``."""
    return spark.read.schema(RUN_SCHEMA).parquet(path).withColumn("loss", F.try_element_at("metrics", F.lit(metric)))


def best_runs(runs: DataFrame, keys: Sequence[str], loss: str, at: str) -> DataFrame:
    """The run with the least loss per key, the earliest one on ties; an aggregate, so any number of runs is fine."""
    rest = [c for c in runs.columns if c not in keys]
    best = runs.filter(q(loss).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*[q(c) for c in rest]), F.struct(q(loss), q(at))).alias("r"))
    return best.select(*keys, "r.*")
