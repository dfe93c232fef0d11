"""From a panel to normalised samples: window -> split -> normalise -> filter -> compute.

The setters only record settings; ``compute`` returns lazy DataFrames for all blocks at once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.scalars import finite
from panelweave.operators.evaluate import split_statistics
from panelweave.operators.quality import dedupe_last
from panelweave.operators.scale import norm_by_block, norm_by_window, norm_by_window_and_entity, scale_samples
from panelweave.operators.select import include_exclude, keep_members, with_position
from panelweave.operators.windows import (
    WindowSize,
    calendar,
    complete_samples,
    label_samples,
    last_step,
    sample_rejects,
    samples_long,
    series_split,
    static_split,
    windows_table,
    with_index,
)
from panelweave.session import staged
from panelweave.sources.tables import export_csv, export_splits, fingerprint, read_csv, read_side_file, write_side_file
from panelweave.spec import PanelSpec, q

METHODS = ("block", "time", "set", "no")


@dataclass
class Samples:
    """Result of ``SamplePlan.compute``: lazy tables plus the column lists that describe them."""

    spec: PanelSpec
    features: list[str]
    targets: list[str]
    windows: DataFrame
    samples: DataFrame
    rejects: DataFrame
    norm: DataFrame | None
    panel: DataFrame = field(repr=False)
    settings: dict = field(default_factory=dict)

    def block(self, key: str) -> DataFrame:
        return self.samples.filter(F.col("block") == key)

    def blocks(self) -> list[str]:
        return sorted(r[0] for r in self.windows.select("block").distinct().collect())

    def __len__(self) -> int:
        return len(self.blocks())

    def __iter__(self):
        return ((key, self.block(key)) for key in self.blocks())

    def __getitem__(self, key: str | int) -> DataFrame:
        return self.block(self.blocks()[key] if isinstance(key, int) else key)

    def long(self) -> DataFrame:
        return samples_long(self.samples, self.spec, self.features)

    def last_step(self) -> DataFrame:
        return last_step(self.samples, self.features, self.targets)

    def statistics(self) -> DataFrame:
        return split_statistics(self.samples, self.spec, len(self.features))

    def card(self) -> dict:
        """Settings, column lookups and their fingerprint, next to ``statistics()``: see ``sources.tables.write_side_file``."""
        columns = {"x": dict(enumerate(self.features)), "y": dict(enumerate(self.targets))}
        return {"settings": self.settings, "columns": columns, "fingerprint": fingerprint(settings=self.settings, columns=columns)}

    def series(self, block: str, target: str) -> DataFrame:
        return series_split(self.panel, self.spec, target, self.windows, block)

    def write(self, path: str) -> None:
        """Cache the samples, partitioned for reading one block and split."""
        self.samples.write.mode("overwrite").partitionBy("block", "split").parquet(path)

    def truths(self) -> DataFrame:
        """The properties of each sample with what is to be predicted: a row for each predicted step (0-based)."""
        keys = [c for c in self.samples.columns if c not in ("x", "y")]
        flat = self.samples.select(*keys, F.size("x").cast("bigint").alias("steps"), F.posexplode("y").alias("target_step", "s"))
        return flat.select(*keys, "steps", F.col("target_step").cast("bigint").alias("target_step"), *[F.col("s")[c].alias(f"target_{c}") for c in self.targets])

    def export(self, path: str) -> None:
        """CSV for other tools, a folder per split: the input steps (``steps``), the samples' properties and truth
        (``samples``), the parameters they were scaled by (``norm``, if any), and the card with all schemas.
        """
        spark = self.samples.sparkSession
        tables = {"steps": self.long(), "samples": self.truths()}
        for name, df in tables.items():
            export_splits(df, f"{path}/{name}")
        if self.norm is not None:
            export_csv(self.norm, f"{path}/norm")
            tables["norm"] = self.norm
        write_side_file(spark, f"{path}/card", {**self.card(), "schemas": {name: df.schema.jsonValue() for name, df in tables.items()}})

    @staticmethod
    def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
        """The tables that ``export`` wrote, by name, with the types they had."""
        schemas = read_side_file(spark, f"{path}/card")["schemas"]
        return {name: read_csv(spark, f"{path}/{name}", T.StructType.fromJson(schema)) for name, schema in schemas.items()}

    def store(self, table: str, buckets: int = 8) -> None:
        """Keep the samples as a table, partitioned by block and bucketed by entity, next to the windows, the parameters and the card.

        Grouping or joining the stored samples by entity needs no shuffle, reading a block reads its folder alone.
        """
        spark = self.samples.sparkSession
        self.samples.write.mode("overwrite").partitionBy("block").bucketBy(buckets, self.spec.comp).sortBy(self.spec.comp, "start").saveAsTable(table)
        self.windows.coalesce(1).write.mode("overwrite").saveAsTable(f"{table}_windows")
        if self.norm is not None:
            self.norm.write.mode("overwrite").saveAsTable(f"{table}_norm")
        else:
            spark.sql(f"DROP TABLE IF EXISTS {table}_norm")
        self.rejects.write.mode("overwrite").saveAsTable(f"{table}_rejects")
        kept = {"features": self.features, "targets": self.targets, "spec": asdict(self.spec), "settings": self.settings}
        spark.createDataFrame([(json.dumps(kept),)], "card string").write.mode("overwrite").saveAsTable(f"{table}_card")

    @classmethod
    def load(cls, spark: SparkSession, table: str, panel: DataFrame | None = None) -> Samples:
        """What ``store`` kept; the panel itself is not stored and only ``series`` needs it."""
        kept = json.loads(spark.table(f"{table}_card").first()["card"])
        norm = spark.table(f"{table}_norm") if spark.catalog.tableExists(f"{table}_norm") else None
        return cls(PanelSpec(**kept["spec"]), kept["features"], kept["targets"], spark.table(f"{table}_windows"), spark.table(table), spark.table(f"{table}_rejects"), norm, panel, kept["settings"])

    def example(self, numbers: Sequence[int], seed: int = 7) -> DataFrame:
        """Samples by number (0, 1, ... in the order of a seeded hash), with history, truth and the parameters they were scaled by."""
        keys = ["block", "split", self.spec.comp, "start"]
        placed = with_position(self.samples.withColumn("__h", F.xxhash64(*[q(k) for k in keys], F.lit(seed))), "__h", "number", keys).drop("__h")
        chosen = placed.filter(F.col("number").isin([int(n) for n in numbers]))
        if self.norm is None:
            return chosen.withColumn("norm", F.lit(None).cast("array<struct<feature:string,mean:double,std:double>>"))
        by = [c for c in self.norm.columns if c not in ("feature", "mean", "std")]
        norm = self.norm.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "std"))).alias("norm"))
        return chosen.join(norm, by, "left")


class SamplePlan:
    def __init__(self, panel: DataFrame, spec: PanelSpec, features: Sequence[str], targets: Sequence[str], latest_by: Sequence[str] = ()):
        """``latest_by``: of rows that share entity and period the last in this order (then in that of the measures) counts."""
        self._latest_by = list(latest_by)
        self.panel, self.spec = panel, spec
        self.features, self.targets = list(features), list(targets)
        self._size: WindowSize | None = None
        self._split: tuple[int, int, int] | None = None
        self._single = False
        self._method = "no"
        self._keep_raw: list[str] = []
        self._inputs_only = False
        self._comps: tuple[DataFrame | None, DataFrame | None] = (None, None)

    def window(self, input_width: int, pred_width: int = 1, shift: int = 1) -> SamplePlan:
        if input_width < 1 or pred_width < 1 or shift < 1:
            raise ValueError("window widths and shift must be at least 1")
        self._size = WindowSize(input_width, pred_width, shift)
        return self

    def block_rolling_split(self, train_steps: int, val_steps: int = 1, test_steps: int = 1) -> SamplePlan:
        self._split, self._single = (train_steps, val_steps, test_steps), False
        return self

    def single_time_rolling(self, val_steps: int = 1, test_steps: int = 1) -> SamplePlan:
        """One train window per block."""
        self._split, self._single = (1, val_steps, test_steps), True
        return self

    def normalize(self, method: str, keep_raw: Sequence[str] = (), exclude_target_periods: bool = False) -> SamplePlan:
        """``exclude_target_periods`` takes window parameters from the input periods alone (methods time and set)."""
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if method == "block" and self._single:
            raise ValueError("block normalisation needs more than one train window; use 'time' or 'set'")
        if method == "block" and exclude_target_periods:
            raise ValueError("block parameters cover whole train spans; exclude_target_periods needs 'time' or 'set'")
        self._method, self._keep_raw, self._inputs_only = method, list(keep_raw), exclude_target_periods
        return self

    def filter_features(self, just_include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> SamplePlan:
        self.features = include_exclude(self.features, just_include, exclude)
        return self

    filter_columns = filter_features

    def filter_y(self, just_include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> SamplePlan:
        self.targets = include_exclude(self.targets, just_include, exclude)
        return self

    def filter_companies(self, just_include: Sequence | DataFrame | None = None, exclude: Sequence | DataFrame | None = None) -> SamplePlan:
        """Filters samples only: parameters stay those of the whole panel. Long lists come as a one-column frame."""
        self._comps = (self._members(just_include), self._members(exclude))
        return self

    def _members(self, comps: Sequence | DataFrame | None) -> DataFrame | None:
        if comps is None:
            return None
        if isinstance(comps, DataFrame):
            return comps.toDF(self.spec.comp)
        kind = self.panel.schema[self.spec.comp].dataType
        return self.panel.sparkSession.createDataFrame([(c,) for c in comps], T.StructType([T.StructField(self.spec.comp, kind)]))

    def static_split(self, val_time: float, test_time: float, val_comp: float = 0.0, test_comp: float = 0.0) -> DataFrame:
        """Rows labelled by one fixed split instead of rolling blocks."""
        return static_split(self.panel, self.spec, self._need_size(), val_time, test_time, val_comp, test_comp)

    def _need_size(self) -> WindowSize:
        if self._size is None:
            raise ValueError("call window(...) first")
        return self._size

    def compute(self, materialise: bool = False) -> Samples:
        """Lazy tables for all blocks; the calendar and the windows are written first. The panel is read for its calendar, samples,
        parameters and rejects; where it is derived from raw rows, ``materialise`` writes it to the checkpoint folder, too."""
        size = self._need_size()
        if self._split is None:
            raise ValueError("call block_rolling_split(...) or single_time_rolling(...) first")
        spec = self.spec
        cols = list(dict.fromkeys([*self.features, *self.targets]))
        order = [c for c in self._latest_by if c not in (*cols, *spec.keys)]
        panel = self.panel.select(spec.comp, spec.period, *[q(c) for c in (*cols, *order) if c not in spec.keys])
        if materialise:
            panel = staged(panel, "panel")
        # Both are as long as the calendar; staged, their size is known and they are not unfolded again at every use.
        cal = staged(calendar(panel, spec), "calendar")
        windows = staged(windows_table(cal, spec, size, *self._split).coalesce(1), "windows")
        raw = with_index(panel, spec, cal)
        # Dealt out by entity first: de-duplication, samples and parameters per entity share that shuffle.
        last = [q(c) for c in dict.fromkeys([*self._latest_by, *cols])]
        indexed = dedupe_last(raw.repartition(q(spec.comp)), [spec.comp, "idx"], last).drop(*order)
        indexed = indexed.withColumns({c: finite(q(c)) for c, t in indexed.dtypes if c in cols and t in ("double", "float")})
        samples = complete_samples(indexed, spec, size, self.features, self.targets)
        include, exclude = self._comps
        if include is not None:
            samples = keep_members(samples, include, spec.comp)
        if exclude is not None:
            samples = keep_members(samples, exclude, spec.comp, exclude=True)

        scale_cols = [c for c in cols if c not in self._keep_raw]
        norm: DataFrame | None = None
        norm_size = WindowSize(size.input_width, 0, size.shift) if self._inputs_only else size
        if self._method == "time":
            norm = norm_by_window(indexed, norm_size, scale_cols, windows)
            # Parameters depend on the window only, so samples are scaled once, before blocks multiply them.
            samples = label_samples(scale_samples(samples, norm, ["start"], scale_cols), windows)
        elif self._method == "set":
            norm = norm_by_window_and_entity(indexed, spec, norm_size, scale_cols, windows)
            samples = label_samples(scale_samples(samples, norm, ["start", spec.comp], scale_cols), windows)
        elif self._method == "block":
            norm = norm_by_block(indexed, windows, scale_cols)
            samples = scale_samples(label_samples(samples, windows), norm, ["block"], scale_cols)
        else:
            samples = label_samples(samples, windows)
        rejects = sample_rejects(raw, spec, size, windows)
        return Samples(spec, self.features, self.targets, windows, samples, rejects, norm, panel, self._settings())

    def _settings(self) -> dict:
        size = self._need_size()
        return {
            "input_width": size.input_width,
            "pred_width": size.pred_width,
            "shift": size.shift,
            "split": dict(zip(("train", "val", "test"), self._split or ())),
            "normalize": self._method,
            "keep_raw": self._keep_raw,
            "exclude_target_periods": self._inputs_only,
            "companies": [n for n, c in zip(("just_include", "exclude"), self._comps) if c is not None],
        }
