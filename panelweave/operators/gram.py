"""Correlations of wide frames with gaps: pairwise-complete matrix products per task, added up by Spark.

With X the values around a common centre (0 where missing) and M the marks of what is there, the products M'M, X'M,
(X*X)'M and X'X hold, for every pair of columns, the count, sums, sums of squares and sum of products over the rows
where both are present. They are plain sums: a task adds its batches up in matrices and emits a row per pair, Spark's own
aggregate adds up the tasks' rows. The plan does not grow with the number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.scalars import finite
from panelweave.spec import q

SUMS = ["n", "sa", "sb", "saa", "sbb", "sab"]
#: A column whose variance over a pair's rows is below this share of its mean square there (around the centre) is constant there:
#: what is left of its sums is then rounding.
CONSTANT = 1e-12


def pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) for every pair a < b of positions in ``cols``: sums over the rows where both are present.

    Values are taken around the mean of the whole column. NaN and infinities count as missing. A pair without a common row has zeros.
    """
    k = len(cols)
    values = df.select(*[finite(q(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    # One small row: a mean for each column.
    means = values.agg(*[F.avg(c).alias(c) for c in values.columns]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    upper = np.triu_indices(k, 1)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, p = (np.zeros((k, k)) for _ in range(4))
        seen = False
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centre
            there = np.isfinite(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            n += m.T @ m
            s += x.T @ m
            ss += (x * x).T @ m
            p += x.T @ x
            seen = seen or len(x) > 0
        if seen:
            a, b = upper
            sums = [n[upper], s[upper], s.T[upper], ss[upper], ss.T[upper], p[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), *[pa.array(v, pa.float64()) for v in sums]], names=["a", "b", *SUMS])

    schema = "a int, b int, " + ", ".join(f"{c} double" for c in SUMS)
    parts = values.mapInArrow(per_task, schema)
    # Pairs of a table without rows are there too.
    ids = df.sparkSession.range(k * k).select((F.col("id") / k).cast("int").alias("a"), (F.col("id") % k).cast("int").alias("b")).filter("a < b")
    zeros = ids.select("a", "b", *[F.lit(0.0).alias(c) for c in SUMS])
    return parts.unionByName(zeros).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SUMS])


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, n, r) for every pair in column order: Pearson r over the rows where both are present, NULL where undefined."""
    c = F.col
    n = F.nullif(c("n"), F.lit(0.0))

    def spread(s: Column, ss: Column) -> Column:
        own = ss - s * s / n
        return F.when(own > CONSTANT * ss, own)

    r = (c("sab") - c("sa") * c("sb") / n) / F.sqrt(spread(c("sa"), c("saa"))) / F.sqrt(spread(c("sb"), c("sbb")))
    names = F.array(*[F.lit(x) for x in cols])
    return pair_sums(df, cols).select(
        names[c("a")].alias("col_a"), names[c("b")].alias("col_b"), c("n").cast("long").alias("n"), F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r")
    )
