"""Work lists, request status and error logs as append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.link import chunk_entities
from panelweave.operators.quality import dedupe_last
from panelweave.sources.tables import append
from panelweave.spec import q

OPEN, DONE, FAILED = 0, 1, -1
SHORT = 40


def work_list(entities: DataFrame, key: str, size: int, fields: Sequence[str], task_id: int = 0) -> DataFrame:
    """One open request per chunk of ``size`` entities."""
    chunks = chunk_entities(entities, key, size)
    return chunks.select(
        "request_id",
        F.lit(task_id).alias("task_id"),
        F.to_json("entities").alias("req_instruments"),
        F.to_json(F.array(*[F.lit(f) for f in fields])).alias("req_fields"),
        F.lit(OPEN).alias("status"),
        F.current_timestamp().alias("last_updated"),
    )


def latest_status(events: DataFrame, request: str, at: str, tiebreak: str) -> DataFrame:
    """Current state = the last status event per request. Nothing is updated in place."""
    return dedupe_last(events, [request], [at, tiebreak])


def set_status(spark: SparkSession, path: str, request_id: int, status: int) -> None:
    """Append one status event."""
    event = spark.range(1).select(
        F.lit(request_id).cast("bigint").alias("request_id"), F.lit(status).alias("status"), F.current_timestamp().alias("last_updated")
    )
    append(event, path)


def shorten_common(message: Column, commons: Sequence[str], length: int = SHORT) -> Column:
    """Messages that start with a known common text keep their first ``length`` characters."""
    common = F.lit(False)
    for text in commons:
        common = common | message.startswith(text)
    return F.when(common, F.substring(message, 1, length)).otherwise(message)


def error_rows(failed: DataFrame, request: str, kind: str, message: str, commons: Sequence[str]) -> DataFrame:
    return failed.select(
        q(request).alias("request_id"), q(kind).alias("error_type"), shorten_common(q(message), commons).alias("error_message")
    )
