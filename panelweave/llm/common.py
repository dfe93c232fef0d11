"""Staging in the shared folder, safe column names and packed binary columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session may lack one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="panelweave-llm-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def only(df: DataFrame, **names: str) -> DataFrame:
    """Just these columns, under the operator's own names, so that other columns can't clash with its work."""
    return df.select(*[df[q(column)].alias(alias) for alias, column in names.items()])


def free_names(df: DataFrame, *bases: str) -> list[str]:
    """The names given, with underscores added until none is a column of ``df`` (case-insensitively)."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        while base.lower() in taken:
            base += "_"
        taken.add(base.lower())
        out.append(base)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_count(text: Column, pattern: str = r"[^\x20\x09-\x0D]+") -> Column:
    from pyspark.sql import functions as F

    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def pack5(x: np.ndarray) -> bytes:
    """The low 40 bits of each number, five bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack5(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def joined(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column in one array, and how many each row holds."""
    parts = [np.frombuffer(x, dtype=dtype) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(x) for x in parts], dtype=np.int64)
