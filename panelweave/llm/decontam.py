"""Benchmark decontamination: a prefix-filtered set join of corpus texts with item-sized windows.

A window is ``window`` consecutive words of an item (a shorter item is one window). A text that holds a window holds
all of its shingles, so containment of 1.0 makes one shingle a sufficient prefix: the rarest one, by the number of
corpus documents that hold it. Two passes over the texts, both without a shuffle:

1. count, for every shingle of the items, the documents that hold it (summed per task first);
2. look up each text's shingles among the windows' prefix shingles. A match at one place fixes where the window would
   start; it must lie within the document (positional and length bound) and all of its words must agree.

Items come to the tasks in blocks of ``BLOCK_BYTES`` (plus one item). One block is one pass; a larger benchmark is
walked block by block in the same job, each adding the spans that it found, so no side is ever broadcast whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import free_names, only, q
from panelweave.llm.wordhash import ALNUM, Words, shingle_hashes, words_of

#: Bytes of item text in a block, and so what a task holds of a benchmark at once.
BLOCK_BYTES = 4_000_000
SIZE = 5


@dataclass
class Tokens:
    """Shingles of one size: sorted hashes, and the windows that have each as prefix with its offset in them."""

    size: int
    hashes: np.ndarray
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    windows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word index, token index) wherever a text holds one of the shingles."""
        all_ = shingle_hashes(words.hashes, self.size)
        at = np.flatnonzero(self.sieve[(all_ & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.hashes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, all_[at]), len(self.hashes) - 1)
        same = self.hashes[k] == all_[at]
        return at[same], k[same]


@dataclass
class Block:
    """The distinct windows of some items: their words, and the items that hold each."""

    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: np.ndarray
    tokens: list[Tokens]


def _windows(rows: Sequence[tuple[str | None, str | None]], window: int) -> Block:
    """Distinct windows of the items, with all of their shingles as tokens still."""
    names = [x for x, _ in rows]
    words, starts, lengths, owner, hashes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    base = 0
    for w in words_of(pa.array([x for _, x in rows], pa.string()), ALNUM):
        for d, n in enumerate(w.counts):
            if n == 0:
                continue
            length = min(window, n)
            own = w.hashes[w.first[d] : w.first[d + 1]]
            words.append(own)
            hashes.append(shingle_hashes(own, length) + np.uint64(length))
            starts.append(base + np.arange(n - length + 1))
            lengths.append(np.full(n - length + 1, length))
            owner.append(np.full(n - length + 1, w.rows.start + d))
            base += n
    words_, starts_, lengths_, owner_ = (np.concatenate(x) for x in (words, starts, lengths, owner))
    _, place, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    first = np.searchsorted(which[order], np.arange(len(place) + 1))
    block = Block(words_, starts_[place], lengths_[place], first, np.array(names, dtype=object)[owner_[order]], [])
    for size in sorted({min(SIZE, int(x)) for x in block.lengths}):
        block.tokens.append(Tokens(size, np.unique(shingle_hashes(words_, size))))
    return block


def _with_prefixes(block: Block, counts: dict[tuple[int, int], int]) -> Block:
    """Keep each window's rarest shingle only; of equally rare ones the smallest hash."""
    kept = []
    for t in block.tokens:
        own = np.flatnonzero(np.minimum(SIZE, block.lengths) == t.size)
        all_ = shingle_hashes(block.words, t.size)
        often = np.array([counts.get((t.size, int(x.astype(np.int64))), 0) for x in t.hashes], dtype=np.int64)
        rank = np.argsort(np.lexsort((t.hashes, often)))
        token = np.searchsorted(t.hashes, all_)
        best = [int(np.argmin(rank[token[s : s + n - t.size + 1]])) for s, n in zip(block.starts[own], block.lengths[own], strict=True)]
        offsets = np.array(best, dtype=np.int64)
        hashes = all_[block.starts[own] + offsets]
        order = np.argsort(hashes, kind="stable")
        distinct = np.unique(hashes)
        kept.append(Tokens(t.size, distinct, np.searchsorted(hashes[order], np.r_[distinct, np.uint64(0)])[:-1], own[order], offsets[order]))
        kept[-1].first = np.r_[kept[-1].first, len(order)]
    block.tokens = kept
    return block


def _counted(broadcast):
    """Documents that hold each shingle of a block, summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = broadcast.value.tokens
        total = [np.zeros(len(t.hashes), dtype=np.int64) for t in tokens]
        for batch in batches:
            for words in words_of(batch.column("text"), ALNUM):
                doc = np.repeat(np.arange(len(words.counts)), words.counts)
                for t, sums in zip(tokens, total, strict=True):
                    at, k = t.found(words)
                    inside = doc[at] == doc[at + t.size - 1]
                    pairs = np.unique(doc[at][inside] * np.int64(len(t.hashes)) + k[inside])
                    sums += np.bincount(pairs % len(t.hashes) if len(pairs) else pairs, minlength=len(t.hashes))
        for t, sums in zip(tokens, total, strict=True):
            some = sums > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), t.size, np.int32)), pa.array(t.hashes[some].view(np.int64)), pa.array(sums[some])], ["size", "token", "docs"])

    return run


def hits_of(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(start as word index of the slice, window) of every occurrence of a window."""
    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    for t in block.tokens:
        at, k = t.found(words)
        n = t.first[k + 1] - t.first[k]
        each = np.repeat(np.arange(len(at)), n)
        entry = np.repeat(t.first[k] - (np.cumsum(n) - n), n) + np.arange(len(each))
        window = t.windows[entry]
        start = at[each] - t.offsets[entry]
        length = block.lengths[window]
        own = doc[at[each]]
        good = (start >= words.first[own]) & (start + length <= words.first[own + 1])
        start, window, length = start[good], window[good], length[good]
        for j in range(int(length.max()) if len(length) else 0):
            here = length > j
            same = np.ones(len(start), dtype=bool)
            same[here] = words.hashes[start[here] + j] == block.words[block.starts[window[here]] + j]
            start, window, length = start[same], window[same], length[same]
        starts.append(start)
        windows.append(window)
    return np.concatenate(starts), np.concatenate(windows)


def _marked(broadcast, text: str, spans: str, found: str, last: bool, keep: Sequence[str]):
    """Add a block's spans and items to each row; the last pass turns them into counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = broadcast.value if broadcast is not None else None
        for batch in batches:
            names = batch.schema.names
            before = batch.column(names.index(spans)).to_pylist() if spans in names else [None] * batch.num_rows
            items_before = batch.column(names.index(found)).to_pylist() if found in names else [None] * batch.num_rows
            out: list[list] = [[], [], []]
            for words in words_of(batch.column(names.index(text)), ALNUM):
                start, window = hits_of(words, block) if block is not None else (np.zeros(0, np.int64),) * 2
                doc = np.searchsorted(words.first, start, "right") - 1
                order = np.argsort(doc, kind="stable")
                edges = np.searchsorted(doc[order], np.arange(len(words.counts) + 1))
                for d, n in enumerate(words.counts):
                    row = words.rows.start + d
                    mine = order[edges[d] : edges[d + 1]]
                    own = np.stack([start[mine] - words.first[d], start[mine] - words.first[d] + block.lengths[window[mine]]], 1) if len(mine) else np.zeros((0, 2), np.int64)
                    items = {str(x) for w in np.unique(window[mine]) for x in block.items[block.first[w] : block.first[w + 1]] if x is not None} if len(mine) else set()
                    if before[row]:
                        own = np.concatenate([np.frombuffer(before[row], dtype=np.int64).reshape(-1, 2), own])
                        items |= set(items_before[row])
                    out[0].append(int(n))
                    out[1].append(own)
                    out[2].append(sorted(items))
            kept = [batch.column(names.index(k)) for k in keep]
            if not last:
                yield pa.RecordBatch.from_arrays([*kept, pa.array([x.tobytes() for x in out[1]], pa.binary()), pa.array(out[2], pa.list_(pa.string()))], [*keep, spans, found])
                continue
            hit = []
            for n, own in zip(out[0], out[1], strict=True):
                cover = np.zeros(n + 1, dtype=np.int64)
                np.add.at(cover, own[:, 0], 1)
                np.add.at(cover, own[:, 1], -1)
                hit.append(int((np.cumsum(cover) > 0).sum()) if len(own) else 0)
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in out[2]]
            results = [pa.array(out[0], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in out[2]], pa.int64()), pa.array(digest, pa.string()), pa.array(out[2], pa.list_(pa.string())), pa.array([x > 0 for x in hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*kept, *results], [*keep, *RESULTS])

    return run


RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "items", "contaminated"]
_TYPES = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.ArrayType(T.StringType()), T.BooleanType()]


def benchmark_hits(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and what it holds of the items, one row for each row.

    Words are runs of 0-9, a-z (A-Z lower-cased) and any non-ASCII characters. ``n_hit`` counts the words inside any
    occurrence of a window, ``items`` lists the ids (as strings, sorted, distinct) of items with such a window.
    A null or empty text has no words, as an item it has no windows; an item of null id marks words but is not
    listed; items that share an id count once. No items: nothing is hit. ``keep`` may not name a result column.
    """
    spark = docs.sparkSession
    clash = {x.lower() for x in keep} & set(RESULTS)
    if clash:
        raise ValueError(f"columns {sorted(clash)} of the documents have names of results")
    rows = only(items, id=item_id, text=item_text).select(F.col("id").cast("string").alias("id"), "text").filter("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    text = only(docs, text=text_column)
    own_columns = list(dict.fromkeys([*keep, text_column]))
    done = docs.select(*[q(x) for x in own_columns])
    spans, found = free_names(docs, "spans_", "found_")
    for k in range(n_blocks):
        last = k == n_blocks - 1
        own = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).collect()
        held = None
        if own:
            block = spark.sparkContext.broadcast(_windows([(r["id"], r["text"]) for r in own], window))
            counts = text.mapInArrow(_counted(block), "size int, token long, docs long").groupBy("size", "token").agg(F.sum("docs").alias("docs")).collect()
            held = spark.sparkContext.broadcast(_with_prefixes(block.value, {(r["size"], r["token"]): r["docs"] for r in counts}))
        if last:
            fields = [docs.schema[x] for x in keep] + [T.StructField(n, t) for n, t in zip(RESULTS, _TYPES, strict=True)]
            done = done.mapInArrow(_marked(held, text_column, spans, found, True, list(keep)), T.StructType(fields))
        else:
            fields = [docs.schema[x] for x in own_columns] + [T.StructField(spans, T.BinaryType()), T.StructField(found, T.ArrayType(T.StringType()))]
            done = done.mapInArrow(_marked(held, text_column, spans, found, False, own_columns), T.StructType(fields))
    return done


def drop_contaminated(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; columns as they are. See ``benchmark_hits``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    marked = benchmark_hits(plain, items, names[docs.columns.index(text_column)], item_id, item_text, window, keep=names)
    return marked.filter("not contaminated").select(*names).toDF(*docs.columns)
