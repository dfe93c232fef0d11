"""Statistics per group and period, and their use on the rows of the group.

Groups (industries, sectors) are few and can be hot, so they are never window partitions: every statistic is
an aggregate with map-side combine, and ``join_group`` carries it back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.scalars import logistic
from panelweave.session import staged
from panelweave.spec import PanelSpec, q

# Copies of each group statistic; a hot group's rows spread over this many join partitions.
SALTS = 16


def join_group(rows: DataFrame, stats: DataFrame, keys: Sequence[str], spread_by: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join rows to a small per-group table without sending a hot group to one task.

    ``stats`` has one row per key, so it is copied ``salts`` times and the rows pick a copy by a hash of
    ``spread_by``. Spark still broadcasts ``stats`` by itself when its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(q(spread_by)), F.lit(salts)).cast("int"))
    copies = stats.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def group_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Mean of every measure per group and period."""
    return df.groupBy(*keys).agg(*[F.avg(q(c)).alias(c + suffix) for c in cols])


def group_max(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(q(c)).alias(c) for c in cols])


def group_levels(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """Mean, sample standard deviation and count per period and per (group, period), in one grouping-sets pass.

    ``level`` is 'period' (group is NULL) or 'industry'. Spark expands each row once per level before its
    partial aggregation.
    """
    aggs = [f(q(c)).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))]
    sets = [[q(spec.period)], [q(spec.period), q(spec.industry)]]
    return (
        df.groupingSets(sets, q(spec.period), q(spec.industry))
        .agg(F.when(F.grouping(q(spec.industry)) == 1, "period").otherwise("industry").alias("level"), *aggs)
    )


def compare_to_group(df: DataFrame, spec: PanelSpec, cols: Sequence[str], by: Sequence[str | Column] = ()) -> DataFrame:
    """Each measure becomes 1 when it is at least the mean of its own group and period, else 0 (NULL gives 0)."""
    keys = [spec.industry, spec.period]
    means = group_mean(df, keys, cols, "__mean")
    joined = join_group(df, means, keys, spread_by=spec.comp)
    return joined.select(
        spec.comp,
        *[q(k) for k in keys],
        *[F.when(q(c) >= q(f"{c}__mean"), 1).otherwise(0).cast("bigint").alias(c) for c in cols],
    )


def attach_group_mean(df: DataFrame, spec: PanelSpec, cols: Sequence[str], suffix: str = "_avg") -> DataFrame:
    """Append the mean of the row's own group and period."""
    keys = [spec.industry, spec.period]
    return join_group(df, group_mean(df, keys, cols, suffix), keys, spread_by=spec.comp)


def group_change(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """Period-over-period change of each group's mean."""
    means = group_mean(df, [spec.industry, spec.period], cols)
    w = Window.partitionBy(spec.industry).orderBy(spec.period)
    return means.select(
        spec.industry, spec.period, *[(F.try_divide(q(c), F.lag(q(c)).over(w)) - 1).alias(f"{c}_change") for c in cols]
    )


def median_count_per_period(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """Per column, the median over periods of its non-null count (one histogram entry per period at most)."""
    counts = df.groupBy(spec.period).agg(*[F.count(q(c)).alias(c) for c in cols])
    return counts.agg(*[F.median(q(c)).alias(c) for c in cols])


def asof_lookup(left_keys: DataFrame, right: DataFrame, on: str, value_cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For every distinct key of ``left_keys``: the values of the last right key at or before it, within the same ``by``.

    Keys of both sides are dealt out in sorted ranges. A range looks up its own keys; what a range starts with is the last row of
    the ranges before it, carried over a table of one row per range and group. So no task holds more than a range, however many
    keys there are. Of several right rows with one key the greatest counts. A key before every right key has no values; keys of a null group drop out.
    """
    by, keys = list(by), [*by, on]
    left = left_keys.select(*[q(c) for c in keys]).distinct().withColumn("__mine", F.lit(True))
    marks = right.groupBy(*[q(c) for c in keys]).agg(F.max(F.struct(*[q(c) for c in value_cols])).alias("__row"))
    both = left.join(marks, keys, "full_outer").filter(q(on).isNotNull())
    order = [q(c) for c in keys]
    dealt = staged(both.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "asof")
    ends = dealt.groupBy(*by, "__range").agg(F.max_by("__row", F.when(F.col("__row").isNotNull(), q(on))).alias("__end"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "__range", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    inside = Window.partitionBy(*by, "__range").orderBy(on).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.select(*keys, "__mine", "__range", F.last("__row", ignorenulls=True).over(inside).alias("__row"))
    found = own.filter("__mine").join(carried, [*by, "__range"]).withColumn("__row", F.coalesce("__row", "__before"))
    return found.select(*keys, *[F.col("__row")[c].alias(c) for c in value_cols])


def group_blend(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """Confidence-blended mean per (group, period), used to fill series that are empty.

    With n = filled rows of the group, N = all its rows, r = (sd / mean of the group) / (sd / mean of the period):
    score = min(1, n/10 * n/N) / 3 + (1 - logistic(r - 1)) * 2/3, and the fill is
    mean_group * score + mean_period * (1 - score), falling back to mean_group, then mean_period.
    """
    inner = df.groupBy(spec.industry, spec.period).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[f(q(c)).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))],
    )
    # The period level is pooled from the group level: a period holds one row per group, and the panel is read once.
    period = Window.partitionBy(spec.period)

    def pooled(c: str) -> list[Column]:
        n, m = q(f"n_{c}"), q(f"m_{c}")
        return [F.sum(n).over(period).alias(f"np_{c}"), F.try_divide(F.sum(n * m).over(period), F.sum(n).over(period)).alias(f"mp_{c}")]

    def squares(c: str) -> Column:
        n, gap = q(f"n_{c}"), q(f"m_{c}") - q(f"mp_{c}")
        total = F.sum(n * q(f"v_{c}") + n * gap * gap).over(period)
        return F.sqrt(F.try_divide(total, q(f"np_{c}") - 1)).alias(f"sp_{c}")

    both = inner.select("*", *[e for c in cols for e in pooled(c)])
    both = both.select("*", *[squares(c) for c in cols])

    def blend(c: str) -> Column:
        mg, ng, mp, sp = (q(f"{k}_{c}") for k in ("m", "n", "mp", "sp"))
        sg = F.sqrt(F.try_divide(q(f"v_{c}") * ng, ng - 1))
        fullness = F.least(F.lit(1.0), (ng / 10) * F.try_divide(ng, F.col("__rows")))
        r = F.try_divide(F.try_divide(sg, mg), F.try_divide(sp, mp))
        score = fullness / 3 + (1 - logistic(r - 1)) * 2 / 3
        return F.coalesce(mg * score + mp * (1 - score), mg, mp).alias(c)

    return both.select(spec.industry, spec.period, *[blend(c) for c in cols])


def reduce_to_yearly(df: DataFrame, spec: PanelSpec, col: str, year: str, quarter: str) -> DataFrame:
    """Keep, per entity, the rows of the quarter in which the lagged measure varies most; set the quarter to 0.

    Variation is the sample standard deviation by quarter of the value one row earlier. Ties go to the later
    quarter; entities without any defined deviation are dropped.
    """
    lagged = df.select("*", F.lag(q(col)).over(spec.ordered()).alias("__lag"))
    spread = Window.partitionBy(spec.comp, quarter)
    rated = lagged.select("*", F.stddev_samp("__lag").over(spread).alias("__sd"))
    best = F.max(F.when(F.col("__sd").isNotNull(), F.struct(F.col("__sd"), q(quarter).alias("__q")))).over(spec.whole())
    kept = rated.select("*", best.alias("__best")).filter(q(quarter) == F.col("__best.__q"))
    return kept.drop("__lag", "__sd", "__best").withColumn(quarter, F.lit(0).cast("bigint"))
