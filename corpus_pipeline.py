"""A corpus from raw documents to token files: stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm.common import new_path
from panelweave.llm.decontam import drop_contaminated
from panelweave.llm.jaccard_join import drop_similar
from panelweave.llm.langmix import keep_languages
from panelweave.llm.mixing import mixed_documents
from panelweave.llm.queries import tokenizer_path
from panelweave.llm.token_planes import tokens_round_trip

#: Most bytes sent to Python at once, and rows that Parquet's reader decodes at once. Spark's own (64 MB or 10,000 rows, and 4,096 rows)
#: suit short rows: of documents, each is tens of megabytes in every running task, several times over while buffers grow.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bytes(setting: str) -> int:
    """A number as Spark's settings state it, with or without a unit."""
    digits = setting.strip().lower().removesuffix("b")
    unit = "kmgt".find(digits[-1:]) + 1 if digits[-1:].isalpha() else 0
    return int(digits[:-1] if unit else digits) << 10 * unit


def in_text_batches(stage: Stage) -> Stage:
    """``stage`` with batches of ``TEXT_BATCHES`` at most. Its frame runs later, so the settings stay with the session."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, most in TEXT_BATCHES.items():
            if not 0 < _bytes(spark.conf.get(key)) <= most:
                spark.conf.set(key, most)
        return stage(spark, docs, sf_dir)

    return run


@contextmanager
def _settings_kept(spark: SparkSession) -> Iterator[None]:
    held = {key: spark.conf.get(key) for key in TEXT_BATCHES}
    try:
        yield
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


@in_text_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no recognisable language go."""
    return keep_languages(docs)


@in_text_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    return drop_similar(docs, size=5, percent=80)


@in_text_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


@in_text_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of the sources takes it."""
    return mixed_documents(docs, weights=(1, 2, 3), most=3)


@in_text_batches
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; a row for each document as it is read back from them."""
    return tokens_round_trip(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]

#: Mixtures, shingle sets and token ids have no SQL counterpart; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with _settings_kept(spark):
        for name, stage in STAGES:
            path = new_path(spark, "pipeline-" + name.split()[0].lower())
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
