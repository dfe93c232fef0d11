"""Running totals and ranks over a whole table, sorted in ranges instead of in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import shuffle_partitions, stage


def with_running_total(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, in the order given. Rows that tie are in either order.

    Rows are dealt out by range; each range is summed, the sums of the ranges before (a row per range) are added.
    The result is staged, so that the ranges stay what they were when it is read more than once.
    """
    dealt = stage(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("range_", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("range_").agg(F.sum(value).alias("sum_"))
    base = sums.select("range_", (F.sum("sum_").over(Window.orderBy("range_")) - F.col("sum_")).alias("base_"))
    own = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn(name, F.sum(value).over(own) - F.col(value)).join(base, "range_").withColumn(name, F.col(name) + F.col("base_")).drop("range_", "base_")
