"""Projection, filtering and positional selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.session import cut_lineage
from panelweave.spec import q


def build_query(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    conditions: Mapping[str, object] | None = None,
    custom_condition: str | None = None,
    distinct: bool = False,
    limit: int | None = None,
    offset: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """SELECT [DISTINCT] columns WHERE col = v / col IN (...) AND custom LIMIT n OFFSET k.

    Without ``order_by`` a limit picks any rows, as in SQL. The custom condition also applies on its own.
    """
    out = df
    for name, value in (conditions or {}).items():
        out = out.filter(q(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else q(name) == F.lit(value))
    if custom_condition:
        out = out.filter(custom_condition)
    if columns:
        out = out.select(*[q(c) for c in columns])
    if distinct:
        out = out.distinct()
    if order_by:
        out = out.orderBy(*order_by)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def include_exclude(columns: Sequence[str], just_include: Sequence[str] | None, exclude: Sequence[str] | None) -> list[str]:
    """Column-list filter: keep the included (all when None), then drop the excluded. Unknown names raise."""
    unknown = (set(just_include or ()) | set(exclude or ())) - set(columns)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return [c for c in columns if (just_include is None or c in just_include) and c not in (exclude or ())]


def keep_members(df: DataFrame, members: DataFrame, key: str, exclude: bool = False) -> DataFrame:
    """Rows whose key is (not) in ``members``. NULL keys are never members."""
    return df.join(members.select(q(key)).distinct(), key, "left_anti" if exclude else "left_semi")


def between_periods(df: DataFrame, period: str, low: int, high: int, comp: str | None = None, value: object = None) -> DataFrame:
    out = df.filter(q(period).between(low, high))
    return out.filter(q(comp) == F.lit(value)) if comp else out


def with_position(df: DataFrame, key: str, alias: str, then: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Append the 0-based global position in the order of a (nearly) unique ``key``; ties go by ``then``.

    A plain window over the whole table would run in one task. Instead rows are dealt out by ranges of (key, then), as
    for a global sort, and staged, so that the ranges stay what they are; each range is numbered on its own and
    starts where the ranges before it end. ``then`` splits even a key that many rows share. NULL comes first, NaN last.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [q(key), *[q(c) for c in then]]
    dealt = cut_lineage(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    numbered = dealt.withColumn("__rn", place).join(starts, "__range")
    return numbered.select(*[q(c) for c in df.columns], (F.col("__start") + F.col("__rn") - 1).alias(alias))


def position_ranges(df: DataFrame, key: str, *pairs: tuple[int | None, int | None]) -> DataFrame:
    """Union of positional row ranges in the order of ``key`` (end exclusive, None = open)."""
    pos = with_position(df, key, "__pos")
    hit: Column = F.lit(False)
    for start, end in pairs:
        one = F.lit(True)
        if start is not None:
            one = one & (F.col("__pos") >= start)
        if end is not None:
            one = one & (F.col("__pos") < end)
        hit = hit | one
    return pos.filter(hit).drop("__pos")


def rename_columns(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Rename by mapping, then lower-case and '.' -> '_'."""
    renamed = df.withColumnsRenamed(dict(names or {}))
    return renamed.toDF(*[c.lower().replace(".", "_") for c in renamed.columns])


def random_examples(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows drawn by a seeded hash of their keys: the same rows on every run and any partitioning."""
    return df.orderBy(F.xxhash64(*[q(k) for k in keys], F.lit(seed)), *keys).limit(n)


def one_hot(df: DataFrame, cols: Mapping[str, Sequence], keys: Sequence[str], null_level: bool = True, drop_first: bool = True) -> DataFrame:
    """0/1 columns ``<col>_<level>``; ``cols`` maps each column to its sorted levels (see ``levels``).

    The first level is dropped; missing values have a level of their own, which is the last.
    """
    out = []
    for c, known in cols.items():
        for level in list(known)[1 if drop_first else 0 :]:
            out.append(F.coalesce((q(c) == F.lit(level)).cast("bigint"), F.lit(0).cast("bigint")).alias(f"{c}_{level}"))
        if null_level:
            out.append(q(c).isNull().cast("bigint").alias(f"{c}_nan"))
    return df.select(*[q(k) for k in keys], *out)


def levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values per column, all columns in one job. They become column names: as many as a schema can hold."""
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), q(c).cast("string").alias("v")) for i, c in enumerate(cols)]))
    seen = df.select(entry.alias("e")).filter("e.v IS NOT NULL").select("e.*").distinct().collect()
    kind = {c: df.schema[c].dataType for c in cols}
    read = lambda c, v: v if isinstance(kind[c], T.StringType) else float(v) if isinstance(kind[c], T.FractionalType) else v == "true" if isinstance(kind[c], T.BooleanType) else int(v)
    return {c: sorted(read(c, r["v"]) for r in seen if r["i"] == i) for i, c in enumerate(cols)}
