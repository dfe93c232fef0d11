"""Dataset registry and the field catalogue with its fill rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelweave.functions.rules import Rule, parse_rule
from panelweave.spec import PanelSpec, q


@dataclass(frozen=True)
class Dataset:
    table: str
    spec: PanelSpec
    target: str


class Registry:
    """Name -> table, key columns and target. Tables are parquet paths or catalogue names."""

    def __init__(self, datasets: Mapping[str, Dataset] | None = None):
        self._datasets = dict(datasets or {})

    def add(self, name: str, dataset: Dataset) -> None:
        self._datasets[name] = dataset

    def __getitem__(self, name: str) -> Dataset:
        if name not in self._datasets:
            raise KeyError(f"{name!r} is not registered; known: {sorted(self._datasets)}")
        return self._datasets[name]

    def scan(self, spark: SparkSession, name: str) -> DataFrame:
        table = self[name].table
        return spark.read.parquet(table) if "/" in table else spark.table(table)


@dataclass(frozen=True)
class Field:
    name: str
    code: str
    data_type: str  # 'time series' | 'property'
    variable_type: str
    rules: tuple[Rule, ...]


def read_catalogue(spark: SparkSession, path: str, name_col: str, code_col: str) -> list[Field]:
    """Read a field catalogue CSV: one row per field, rules in the ``fillnan_*`` columns in their sorted order.

    The catalogue describes columns, so it is as small as a schema and becomes driver-side objects.
    """
    rows = spark.read.option("header", True).option("multiLine", True).csv(path).collect()
    fields = []
    for r in rows:
        row = {re.sub("^﻿", "", k): v for k, v in r.asDict().items()}
        rule_cols = sorted((c for c in row if c.startswith("fillnan_")), key=str.lower)
        texts = [row[c].strip() for c in rule_cols if row[c] and row[c].strip()]
        fields.append(
            Field(
                name=row[name_col].lower(),
                code=row.get(code_col) or "",
                data_type=row.get("Data Type") or "",
                variable_type=row.get("Variable Type") or "",
                rules=tuple(parse_rule(t) for t in texts),
            )
        )
    return fields


def fill_rules(fields: Sequence[Field]) -> dict[str, list[Rule]]:
    """Column -> rules, in catalogue order, fields without rules left out."""
    return {f.name: list(f.rules) for f in fields if f.rules}


def formula_pairs(fields: Sequence[Field]) -> list[tuple[str, str]]:
    return [(f.name, r.body) for f in fields for r in f.rules if r.kind == "formula"]


def with_metadata(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Attach the variable type (stock, flow, ratio, ...) to the schema metadata."""
    known = {f.name: f for f in fields}
    for c in df.columns:
        if c.lower() in known:
            df = df.withMetadata(c, {"variable_type": known[c.lower()].variable_type, "data_type": known[c.lower()].data_type})
    return df


def split_properties(df: DataFrame, properties: Sequence[str], keys: Sequence[str], comp: str) -> tuple[DataFrame, DataFrame]:
    """(property table, time-series table): one row per entity with its most complete properties, and the rest."""
    from panelweave.operators.quality import dedupe_most_complete

    props = df.select(comp, *[q(c) for c in properties])
    best = dedupe_most_complete(props, [comp], properties, list(properties))
    return best, df.select(*[q(c) for c in df.columns if c not in properties or c in keys])
