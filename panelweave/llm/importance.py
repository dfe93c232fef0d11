"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Two bag-of-n-grams models share ``BUCKETS`` hashed words and word pairs: the target one is learned from at most
``max_target`` rows that are labelled good (a documented bound), the raw one from *all* documents. A document's weight
is the ratio of its probabilities under both. Adding Gumbel noise to the log-weight and keeping the k largest keys
draws k documents without replacement in proportion to the weights. Noise is a hash of the row and the seed, so a
rerun draws the same rows; the k largest are found by ranks over sorted ranges, never in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import only
from panelweave.llm.ranks import with_running_total
from panelweave.llm.wordhash import Words, mix64, words_of

BUCKETS = 10_000
MAX_TARGET = 50_000


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and every pair of neighbours."""
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    pair = mix64(words.hashes[:-1] * np.uint64(3) + words.hashes[1:])
    inside = doc[:-1] == doc[1:]
    bucket = np.concatenate([words.hashes, pair[inside]]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([doc, doc[:-1][inside]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for words in words_of(batch.column("text")):
            total += np.bincount(grams(words)[0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def gram_model(texts: DataFrame) -> np.ndarray:
    """Log-probabilities of the buckets over a frame with the column ``text``; one pseudo-count for all buckets together."""
    got = texts.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full(BUCKETS, 1 / BUCKETS)
    counts[got["bucket"].to_numpy(int)] += got["n"].to_numpy(float)
    return np.log(counts / counts.sum())


def resample(docs: DataFrame, target_ids: DataFrame, share: float = 0.5, id_column: str = "doc_id", text_column: str = "text", max_target: int = MAX_TARGET, seed: int = 1) -> DataFrame:
    """(doc_id, n_grams, log_weight, selected) of every row; ``selected`` holds for ``round(share * rows)`` of them.

    ``target_ids`` has ``doc_id``: rows of good text, of which at most about ``max_target`` are used, chosen by a hash; ids
    of no document and nulls are passed over. A null or blank text has no n-grams and log-weight 0 and takes part in the draw.
    Repeated rows are rows of their own with equal keys; which of them is drawn last is open. Without target rows all weights
    are 0 and the draw is uniform.
    """
    spark = docs.sparkSession
    rows = only(docs, doc_id=id_column, text=text_column)
    good = target_ids.select("doc_id").filter("doc_id is not null").distinct()
    keep = min(1.0, max_target / max(1, good.count()))
    # At most about max_target ids: a side of bounded size.
    some = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(keep * 1_000_000))
    target = gram_model(rows.join(F.broadcast(some), "doc_id", "left_semi"))
    raw = gram_model(rows)
    ratio = spark.sparkContext.broadcast(target - raw if some.count() else np.zeros(BUCKETS))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for words in words_of(batch.column("text")):
                bucket, doc = grams(words)
                k = len(words.counts)
                n[words.rows] = np.bincount(doc, minlength=k)
                weight[words.rows] = np.bincount(doc, weights=ratio.value[bucket], minlength=k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n), pa.array(weight)], ["doc_id", "h", "n_grams", "log_weight"])

    kind = docs.schema[id_column].dataType.simpleString()
    scored = rows.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h")).mapInArrow(weigh, f"doc_id {kind}, h long, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned("h", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))).withColumn("one", F.lit(1).cast("long"))
    ranked = with_running_total(keyed, [F.desc("key"), F.col("h")], "one", "before")
    total = ranked.agg(F.count("*")).first()[0]
    return ranked.select("doc_id", "n_grams", "log_weight", (F.col("before") < round(share * total)).alias("selected"))
