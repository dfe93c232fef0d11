"""Language identification by multilingual mixtures.

A document is a mixture of languages. Its letters are cut into segments of ``SEGMENT`` words; a language gives a segment
the product of its letter trigrams' probabilities (a letter with both neighbours, everything else counts as a gap).
Expectation-maximisation estimates the proportions of the languages over the segments. The language set is then the
one of largest penalised likelihood among the nested sets of most probable languages: one more language must raise
the log-likelihood by ``PENALTY`` plus half the logarithm of the number of segments.

The trigram tables are learned from at most ``max_docs`` labelled documents per language (a documented bound; chosen
by a hash of the text where there are more) with ``BUCKETS`` hashed trigrams per language: their size follows the
number of languages only and is checked before the broadcast. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelweave.llm.common import only, stage
from panelweave.llm.wordhash import LOWER, text_slices

BUCKETS = 1 << 16
SEGMENT = 4
MAX_DOCS = 5_000
PENALTY = 6.0
STEPS = 25
#: Tables of more bytes are refused: about 1,000 languages.
TABLE_BYTES = 256_000_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
GAP = np.uint32(32)


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # (language, bucket): log-probability


def trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter's trigram, first letter of each segment, document of each segment)."""
    low = LOWER[raw]
    letter = _LETTER[low]
    shown = np.where(letter, low, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    before, after = np.empty_like(shown), np.empty_like(shown)
    before[1:], after[:-1] = shown[:-1], shown[1:]
    begin, end = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1
    before[begin] = GAP
    after[end] = GAP
    code = (before[at] << np.uint32(16)) | (shown[at] << np.uint32(8)) | after[at]
    bucket = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    word = np.flatnonzero(before[at] == GAP)
    doc = np.searchsorted(off, at[word], "right") - 1
    first = np.searchsorted(doc, doc)
    keep = (np.arange(len(word)) - first) % SEGMENT == 0
    return bucket, word[keep], doc[keep]


def _trained(names: list[str]):
    """(language, bucket, count), summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS), dtype=np.int64)
        number = {x: i for i, x in enumerate(names)}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for rows, raw, off in text_slices(batch.column("text")):
                bucket, start, doc = trigrams(raw, off)
                if len(bucket):
                    own = np.repeat(lang[rows][doc], np.diff(np.r_[start, len(bucket)]))
                    total += np.bincount(own * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((some // BUCKETS).astype(np.int32)), pa.array((some % BUCKETS).astype(np.int32)), pa.array(total.ravel()[some])], ["lang", "bucket", "n"])

    return run


def learn_languages(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", max_docs: int = MAX_DOCS) -> Languages:
    """Trigram tables of the languages of ``labelled``; rows without a text or a language are passed over.

    A language is learned from its ``max_docs`` distinct texts (all, if fewer) that come first in a hashed order, each taken once, so a
    text with many copies neither crowds out the others nor takes its language along. A language whose texts have no
    trigram is left out.
    """
    rows = only(labelled, text=text_column, lang=lang_column).filter("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    texts = rows.groupBy("lang", "h").agg(F.count("*").alias("copies"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))
    drawn = stage(texts.withColumn("place", place).filter(F.col("place") <= max_docs).select("lang", "h"), "drawn")
    names = sorted(r["lang"] for r in drawn.select("lang").distinct().limit(TABLE_BYTES // (4 * BUCKETS) + 1).collect())
    if 4 * BUCKETS * len(names) > TABLE_BYTES:
        raise ValueError(f"too many languages for tables of {TABLE_BYTES} bytes")
    once = rows.join(drawn, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    got = once.select("text", "lang").mapInArrow(_trained(names), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(names), BUCKETS))
    counts[got["lang"].to_numpy(int), got["bucket"].to_numpy(int)] = got["n"].to_numpy(float)
    known = counts.sum(1) > 0
    names, counts = [x for x, k in zip(names, known, strict=True) if k], counts[known] + 0.1
    return Languages(names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def _em(chance: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document, and the log of each segment's mixture; ``chance`` is relative to its best language."""
    share = start / start.sum(1, keepdims=True)
    for _ in range(STEPS):
        part = chance * np.repeat(share, size, axis=0)
        part /= part.sum(1, keepdims=True)
        new = np.add.reduceat(part, first, axis=0) / size[:, None]
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, np.log((chance * np.repeat(share, size, axis=0)).sum(1))


def mixtures(logs: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have segments, their proportions in the selected set) from segment log-likelihoods."""
    docs, first = np.unique(doc, return_index=True)
    size = np.diff(np.r_[first, len(doc)])
    best = logs.max(1)
    chance = np.exp(np.maximum(logs - best[:, None], -60))
    single = np.add.reduceat(logs, first, axis=0)
    share = np.zeros_like(single)
    share[np.arange(len(docs)), single.argmax(1)] = 1
    if logs.shape[1] == 1:
        return docs, share
    whole, mixed = _em(chance, first, size, np.ones_like(single))
    worth = single.max(1)
    limit = np.add.reduceat(mixed + best, first)
    price = PENALTY + 0.5 * np.log(size)
    order = np.argsort(-whole, axis=1, kind="stable")
    open_ = np.flatnonzero(limit - worth > price)
    for k in range(2, logs.shape[1] + 1):
        if not len(open_):
            break
        pick = np.repeat(np.isin(np.arange(len(docs)), open_), size)
        allowed = np.zeros((len(open_), logs.shape[1]))
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        n = size[open_]
        at = np.r_[0, np.cumsum(n)[:-1]]
        own, log = _em(chance[pick], at, n, allowed * (whole[open_] + 1e-6))
        value = np.add.reduceat(log + best[pick], at) - (k - 1) * price[open_]
        better = value > worth[open_]
        share[open_[better]] = own[better]
        worth[open_[better]] = value[better]
        # A further language may still pay where all languages together leave more to gain than its price.
        open_ = open_[limit[open_] - k * price[open_] > worth[open_]]
    return docs, share


def _predicted(broadcast, text: str, keep: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Languages = broadcast.value
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            lettered = pc.match_substring_regex(column, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            lang: list[str] = ["und"] * batch.num_rows
            score = np.zeros(batch.num_rows)
            others: list[list[str]] = [[]] * batch.num_rows
            for rows, raw, off in text_slices(column):
                bucket, start, doc = trigrams(raw, off)
                if not len(start) or not known.names:
                    continue
                logs = np.stack([np.add.reduceat(x[bucket], start, dtype=np.float64) for x in known.logs], axis=1)
                docs, share = mixtures(logs, doc)
                top = share.argmax(1)
                for d, k, own in zip(docs, top, share, strict=True):
                    i = rows.start + int(d)
                    if lettered[i]:
                        lang[i], score[i] = known.names[k], own[k]
                        others[i] = [known.names[j] for j in np.argsort(-own, kind="stable") if own[j] > 0]
            kept = [batch.column(batch.schema.names.index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang), pa.array(np.minimum(score, 1.0)), pa.array(others, pa.list_(pa.string()))], [*keep, *RESULTS])

    return run


RESULTS = ["lang_pred", "score", "languages"]


def identify_languages(docs: DataFrame, known: Languages, text_column: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with its language, that language's proportion, and the selected set.

    ``lang_pred`` is ``und`` with score 0 and no languages for a null text, a text without a letter, or when no
    language was learned. Of equal proportions the alphabetically first language counts. ``keep`` may not name a
    result column; other columns are never read.
    """
    clash = {x.lower() for x in keep} & set(RESULTS)
    if clash:
        raise ValueError(f"columns {sorted(clash)} of the documents have names of results")
    held = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(*dict.fromkeys([*keep, text_column]))
    fields = [docs.schema[x] for x in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType()))]
    return rows.mapInArrow(_predicted(held, text_column, list(keep)), T.StructType(fields))


def fold_of(id_column: Column) -> Column:
    """Fold 0 to 3 of a document by the crc32 of its id as text; a null id is an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 4


def held_out_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", fold: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of every row, learned from the labelled rows of the other folds."""
    rows = only(docs, doc_id=id_column, text=text_column, lang=lang_column)
    known = learn_languages(rows.filter(fold_of(F.col("doc_id")) != fold))
    got = identify_languages(rows, known)
    return got.select("doc_id", (fold_of(F.col("doc_id")) == fold).alias("held_out"), *RESULTS)


def keep_languages(docs: DataFrame, least: float = 0.3, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", fold: int = 2) -> DataFrame:
    """``docs`` without the rows of no language (``und``) and those whose main language has less than ``least``."""
    rows = only(docs, doc_id=id_column, text=text_column, lang=lang_column)
    known = learn_languages(rows.filter(fold_of(F.col("doc_id")) != fold))
    names = [f"c{i}" for i in range(len(docs.columns))]
    got = identify_languages(docs.toDF(*names), known, names[docs.columns.index(text_column)], names)
    return got.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*names).toDF(*docs.columns)
