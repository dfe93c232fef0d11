"""Completeness scores, filters on them, de-duplication, and table differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.scalars import filled_count, finite, text_to_double
from panelweave.operators.gram import pair_correlations
from panelweave.operators.leastsq import PLAIN_VARIABLES
from panelweave.operators.quantiles import exact_quantiles
from panelweave.spec import numeric_columns, q


def drop_empty_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows without a value in any non-key column."""
    return df.dropna(how="all", subset=[c for c in df.columns if c not in keys])


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(required)) if required else df


def clean_text_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns to DOUBLE, with blank and infinity texts as NULL."""
    return df.withColumns({c: text_to_double(q(c)) for c in cols})


def clean_infinities(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns to NULL."""
    floating = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: finite(q(c)) for c in floating})


def row_fill_rate(df: DataFrame, cols: Sequence[str], alias: str = "data_quality") -> DataFrame:
    """Append the non-null count of ``cols`` over the largest such count in the table.

    The maximum is one number, so it is a scalar subquery: no window over the whole table, no shuffle of rows.
    """
    counted = df.select("*", filled_count(*[q(c) for c in cols]).alias("__filled"))
    top = counted.agg(F.max("__filled")).scalar()
    return counted.select(*[q(c) for c in df.columns], F.try_divide(F.col("__filled"), top).alias(alias))


def filter_row_pct(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    return row_fill_rate(df, cols, "__rate").filter(F.col("__rate") >= threshold).drop("__rate")


def fill_histogram(df: DataFrame, cols: Sequence[str], *flags: Column) -> DataFrame:
    """Rows per number of filled ``cols`` (and per flag): at most ``len(cols) + 1`` rows per flag value."""
    return df.groupBy(filled_count(*[q(c) for c in cols]).alias("filled"), *flags).agg(F.count(F.lit(1)).alias("n"))


def fill_rate_quantile(df: DataFrame, cols: Sequence[str], quantile: float) -> Column:
    """q-quantile of the row fill rate as a scalar, exact, from the small fill histogram of one pass."""
    histogram = fill_histogram(df, cols)
    return histogram.agg(F.try_divide(F.percentile("filled", F.lit(quantile), F.col("n")), F.max("filled"))).scalar()


def filter_row_quantile(df: DataFrame, cols: Sequence[str], quantile: float) -> DataFrame:
    """Keep rows at or above the q-quantile of the fill rate over all rows of ``df``."""
    rated = row_fill_rate(df, cols, "__rate")
    return rated.filter(F.col("__rate") >= fill_rate_quantile(df, cols, quantile)).drop("__rate")


def column_fill_rate(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: name, non-null count, and the count over the best column."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count(q(c)).alias(c) for c in cols])
    entry = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).alias("n_filled")) for c in cols]))
    best = F.greatest(*[q(c) for c in cols]) if len(cols) > 1 else q(cols[0])
    return counts.select(entry.alias("e"), best.alias("best")).select(
        "e.column_name", "e.n_filled", F.try_divide("e.n_filled", "best").alias("fill_rate")
    )


def drop_sparse_columns(df: DataFrame, threshold: float, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns filled less than ``threshold`` of the best one. One aggregate pass decides the projection."""
    sparse = {r.column_name for r in column_fill_rate(df).filter(F.col("fill_rate") < threshold).collect()}
    return df.select(*[q(c) for c in df.columns if c in keep or c not in sparse])


def quality_report(
    df: DataFrame, cols: Sequence[str], required: Sequence[str], row_pct: float, row_quantile: float
) -> DataFrame:
    """One row: input rows, rows lost per reason (in the order the filters run), rows kept and their share."""
    complete = F.lit(True)
    for c in required:
        complete = complete & q(c).isNotNull()
    # Everything below works on the histogram of (filled, complete): a few dozen rows after one pass.
    histogram = fill_histogram(df, cols, complete.alias("ok"))
    tiny = Window.partitionBy(F.lit(0))
    top = F.max("filled").over(tiny)
    cut = F.try_divide(F.percentile("filled", F.lit(row_quantile), F.col("n")).over(tiny), top)
    rated = histogram.select("ok", "n", (F.try_divide(F.col("filled"), top) >= F.greatest(F.lit(float(row_pct)), cut)).alias("full"))
    n = F.sum("n")

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("bigint"))

    ok, full = F.col("ok"), F.col("full")
    return rated.agg(
        n.alias("n_input"),
        rows(~ok).alias("dropped_required"),
        rows(ok & ~full).alias("dropped_fill_rate"),
        rows(ok & full).alias("n_kept"),
        F.try_divide(rows(ok & full), n).alias("share_kept"),
    )


def open_range(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Keep rows strictly inside (low, high)."""
    return df.filter((q(col) > low) & (q(col) < high))


def quantile_trim(df: DataFrame, cols: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Keep rows with every column strictly below its upper quantile, then strictly above its lower quantile.

    The lower quantiles are taken on the survivors of the upper cut.
    """
    upper = exact_quantiles(df, {c: [high] for c in cols})
    for c in cols:
        df = df.filter(q(c) < upper[c][0])
    lower = exact_quantiles(df, {c: [low] for c in cols})
    for c in cols:
        df = df.filter(q(c) > lower[c][0])
    return df


def low_information_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns whose (min, max) is (-1,1), (0,1), (0,0) or (1,1): one row per column with its flag."""
    cols = list(cols or numeric_columns(df))
    ends = df.agg(*[F.min(q(c)).alias(f"lo_{c}") for c in cols], *[F.max(q(c)).alias(f"hi_{c}") for c in cols])
    entry = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    q(f"lo_{c}").cast("double").alias("min_value"),
                    q(f"hi_{c}").cast("double").alias("max_value"),
                )
                for c in cols
            ]
        )
    )
    lo, hi = F.col("e.min_value"), F.col("e.max_value")
    flag = ((lo == -1) & (hi == 1)) | ((lo == 0) & (hi == 1)) | ((lo == 0) & (hi == 0)) | ((lo == 1) & (hi == 1))
    return ends.select(entry.alias("e")).select("e.column_name", lo.alias("min_value"), hi.alias("max_value"), flag.alias("low_information"))


def z_score_filter(df: DataFrame, cols: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Keep rows whose population z-score is below ``limit`` in every column; constant columns are ignored."""
    stats = df.agg(*[f(q(c)).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    for c in cols:
        if stats[f"s_{c}"]:
            df = df.filter(F.abs((q(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]) < limit)
    return df


def _pearson(a: Column, b: Column) -> Column:
    """r over rows where both are present; NULL for a constant column (``corr`` raises there in ANSI mode).

    Constant is told by the ends: merged deviations of a constant need not be exactly zero.
    """
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y)))


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every column pair (in column order), each over the rows where both are present; undefined r counts as 0.

    Few columns are one aggregate; wide frames add up matrices per task (``operators.gram``), for an expression per pair
    is more than a plan carries. NaN and infinities count as missing.
    """
    if len(cols) > PLAIN_VARIABLES:
        return pair_correlations(df, cols).select("col_a", "col_b", F.coalesce("r", F.lit(0.0)).alias("r"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    r = df.agg(*[_pearson(finite(q(cols[i]).cast("double")), finite(q(cols[j]).cast("double"))).alias(f"r_{i}_{j}") for i, j in pairs])
    entry = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(cols[i]).alias("col_a"),
                    F.lit(cols[j]).alias("col_b"),
                    F.coalesce(F.nanvl(F.col(f"r_{i}_{j}"), F.lit(0.0)), F.lit(0.0)).alias("r"),
                )
                for i, j in pairs
            ]
        )
    )
    return r.select(entry.alias("e")).select("e.*")


def correlation_prune(df: DataFrame, cols: Sequence[str], limit: float = 0.9) -> DataFrame:
    """One row per column: dropped when r >= limit with any earlier column, dropped or not."""
    pairs = correlation_pairs(df, cols)
    hits = pairs.groupBy(F.col("col_b").alias("column_name")).agg(F.max(F.col("r") >= limit).alias("dropped"))
    first = df.sparkSession.range(1).select(F.lit(cols[0]).alias("column_name"), F.lit(False).alias("dropped"))
    return first.unionByName(hits)


def dedupe_most_complete(df: DataFrame, keys: Sequence[str], cols: Sequence[str], tiebreak: Sequence[str | Column]) -> DataFrame:
    """Keep the row with the most filled ``cols`` per key; ``tiebreak`` must make the order total.

    ``row_number() = 1`` is planned with a per-partition group limit before the shuffle, so a hot key sends
    one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("__filled"), *tiebreak)
    scored = df.select("*", filled_count(*[q(c) for c in cols]).alias("__filled"))
    return scored.select("*", F.row_number().over(w).alias("__rn")).filter("__rn = 1").drop("__rn", "__filled")


def dedupe_last(df: DataFrame, keys: Sequence[str], latest_by: Sequence[str | Column]) -> DataFrame:
    """Keep the last row per key in the order of ``latest_by`` (names or Columns, ascending)."""
    order = [(F.col(c) if isinstance(c, str) else c).desc() for c in latest_by]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", F.row_number().over(w).alias("__rn")).filter("__rn = 1").drop("__rn")


def cell_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Unequal cells of two tables with the same keys: (keys, column_name, from_value, to_value); NULL equals NULL.

    The tables meet once, wide; only the differing cells are turned into rows.
    """
    if set(left.columns) != set(right.columns):
        raise ValueError("both tables need the same columns")
    a = left.select(*keys, *[q(c).alias(f"__a_{c}") for c in cols])
    b = right.select(*keys, *[q(c).alias(f"__b_{c}") for c in cols])
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                q(f"__a_{c}").cast("string" if t == "string" else "double").alias("from_value"),
                q(f"__b_{c}").cast("string" if t == "string" else "double").alias("to_value"),
            )
            for c, t in [(c, dict(left.dtypes)[c]) for c in cols]
        ]
    )
    changed = F.filter(cells, lambda e: ~e["from_value"].eqNullSafe(e["to_value"]))
    return a.join(b, list(keys), "full_outer").select(*keys, F.explode(changed).alias("e")).select(*keys, "e.*")
