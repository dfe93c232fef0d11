"""Reading, appending and caching tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.spec import q


def read_jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str], split_by: str | None = None, bounds: tuple | None = None, parts: int = 64) -> DataFrame:
    """Scan a database table; ``split_by`` with ``bounds`` reads it in parallel ranges. Filters are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if split_by and bounds:
        reader = reader.option("partitionColumn", split_by).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def text_as_string(df: DataFrame) -> DataFrame:
    """Columns that are neither numeric, boolean nor temporal are cast to text."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
    odd = [f.name for f in df.schema if not isinstance(f.dataType, plain)]
    return df.withColumns({c: q(c).cast("string") for c in odd})


def read_through(spark: SparkSession, path: str, load: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The parquet copy at ``path`` when there is one, otherwise load, store and read back."""
    if refresh or not path_exists(spark, path):
        text_as_string(load()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a readable parquet table? Files of an unfinished job stay hidden and do not count."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def read_sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """Run SQL text over named frames."""
    return spark.sql(text, **views)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with an explicit schema: no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).csv(path)


def null_normalised(df: DataFrame) -> DataFrame:
    """Blank text, NaN and infinities as NULL."""
    out: dict[str, Column] = {}
    for f in df.schema:
        c = q(f.name)
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(c != "", c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    return df.withColumns(out) if out else df


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append null-normalised rows; a failed job leaves nothing visible."""
    writer = null_normalised(df).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str]) -> None:
    null_normalised(df).write.mode("append").format("jdbc").option("url", url).option("dbtable", table).options(**properties).save()


# SQL type of each Spark type when a table is created.
SQL_TYPES = {
    "string": "STRING",
    "bigint": "BIGINT",
    "int": "INT",
    "double": "DOUBLE",
    "float": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def create_table(df: DataFrame, name: str) -> bool:
    """Create an empty parquet table with the frame's columns unless it exists; true when created."""
    spark = df.sparkSession
    if table_exists(spark, name):
        return False
    cols = ", ".join(f"`{c}` {SQL_TYPES.get(t, t)}" for c, t in df.dtypes)
    spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet")
    return True


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def fingerprint(**params: object) -> str:
    """Ten hex digits over all parameters, names included."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:10]


def fingerprint_column(*cols: str) -> Column:
    """The row-wise form: ten hex digits over the values joined by '/'."""
    return F.substring(F.sha2(F.concat_ws("/", *[q(c).cast("string") for c in cols]), 256), 1, 10)


def cached_result(spark: SparkSession, root: str, params: Mapping[str, object], build: Callable[[], tuple[DataFrame, DataFrame]], refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(result, report) stored under the fingerprint of ``params``; ``build`` runs only when they are missing."""
    base = f"{root.rstrip('/')}/{fingerprint(**params)}"
    if refresh or not path_exists(spark, f"{base}/report"):
        result, report = build()
        result.write.mode("overwrite").parquet(f"{base}/data")
        report.write.mode("overwrite").parquet(f"{base}/report")
    return spark.read.parquet(f"{base}/data"), spark.read.parquet(f"{base}/report")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_splits(samples: DataFrame, path: str) -> None:
    """Flattened samples as CSV, one folder per split. All splits are written in one job."""
    samples.write.mode("overwrite").option("header", True).partitionBy("split").csv(path)


def write_side_file(spark: SparkSession, path: str, content: Mapping[str, object]) -> None:
    """Lookups, schema or statistics of a prepared block as one JSON row."""
    row = json.dumps(content, sort_keys=True, default=str)
    spark.range(1).select(F.lit(row).alias("value")).write.mode("overwrite").text(path)


def read_side_file(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


