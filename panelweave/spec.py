"""The panel contract: which columns are the entity, the period, the group and the measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class PanelSpec:
    """A panel holds one row per (comp, period).

    Windows partitioned by ``comp`` are only safe because of that contract: one entity can never hold more
    rows than there are periods, however skewed the raw data is. ``as_panel`` establishes the contract,
    ``assert_unique`` checks it.
    """

    comp: str = "comp"
    period: str = "period"
    industry: str = "industry"

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(self.comp).orderBy(self.period)

    def so_far(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def from_here(self) -> WindowSpec:
        """This row and all later ones, nearest last: ``last(..., ignorenulls)`` finds the next value.

        Ordered backwards on purpose: a growing frame costs one step per row, whereas a frame that ends at
        unbounded following is evaluated anew for every row.
        """
        back = Window.partitionBy(self.comp).orderBy(F.col(self.period).desc())
        return back.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(self.comp)

    @property
    def keys(self) -> list[str]:
        return [self.comp, self.period]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when ``keys`` do not identify a row; return ``df`` unchanged otherwise."""
    clash = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"keys {list(keys)} are not unique, for example {clash[0].asDict()}")
    return df


def as_panel(df: DataFrame, spec: PanelSpec, latest_by: Sequence[str | Column]) -> DataFrame:
    """Make (comp, period) unique, keeping the last row in the order of ``latest_by``."""
    from panelweave.operators.quality import dedupe_last

    return dedupe_last(df, spec.keys, latest_by)


def q(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")
