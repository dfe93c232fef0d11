"""Reversible incremental line dedup: sharded cuckoo filters backed by exact reference tables.

State, in a folder that all executors share:

* ``refs``: the exact table, a row for each (key, document) with the shard of the key. A key is the 128-bit hash of a
  line that is stripped of ASCII white space and lower-cased (A-Z). Insertions append, deletions take rows away, so the
  reference count of a key (the documents that hold it) and its keeper (the largest of them) are always exact.
* ``heavy``: key, count and keeper of the keys that at least ``min_docs`` documents hold: those that lose lines.
* ``filters``: for each shard a cuckoo filter over its heavy keys. Insertions add the keys that became heavy, deletions
  take out those that no longer are; a shard that fills up is rebuilt at twice the size from ``heavy``.

To drop lines, texts are probed against the filters; a text without a hit is done. Only texts with a hit are joined with
their exact references, so a false positive costs a lookup and never a line. Filters are broadcast while their bytes are below
``FILTER_BYTES``; beyond that every text takes the exact way.

A shard's rows are split over its keys' hashes: a key that a third of all documents hold is summed per task before it
is shuffled, and its (key, document) rows are only ever scanned, never gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import only, stage

SPACE = b" \t\n\x0b\x0c\r"
#: Filters larger than this together are not broadcast.
FILTER_BYTES = 64_000_000
SLOTS = 4
EMPTY = np.uint16(0)


def _alternate(slot: int, print_: int, mask: int) -> int:
    return (slot ^ (print_ * 0x5BD1E995)) & mask


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; every key has two buckets, each reachable from the other."""

    def __init__(self, capacity: int) -> None:
        buckets = 1
        while buckets * SLOTS * 0.9 < max(1, capacity):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @property
    def mask(self) -> int:
        return len(self.table) - 1

    @staticmethod
    def _print(hi: int) -> int:
        return (hi & 0xFFFF) or 1

    def _home(self, hi: int) -> int:
        return (hi >> 16) & self.mask

    def insert(self, hi: int) -> bool:
        """Add a key (the high half of its hash). False: full, and nothing has changed."""
        print_, slot = self._print(hi), self._home(hi)
        moved: list[tuple[int, int, int]] = []
        for turn in range(500):
            for at in (slot, _alternate(slot, print_, self.mask)):
                free = np.flatnonzero(self.table[at] == EMPTY)
                if len(free):
                    self.table[at, free[0]] = print_
                    return True
            place = turn % SLOTS
            slot = _alternate(slot, print_, self.mask) if turn % 2 else slot
            moved.append((slot, place, int(self.table[slot, place])))
            self.table[slot, place], print_ = print_, int(self.table[slot, place])
            slot = _alternate(slot, print_, self.mask)
        for slot, place, before in reversed(moved):
            self.table[slot, place] = before
        return False

    def delete(self, hi: int) -> bool:
        """Take out one copy of a key's fingerprint."""
        print_, slot = self._print(hi), self._home(hi)
        for at in (slot, _alternate(slot, print_, self.mask)):
            same = np.flatnonzero(self.table[at] == print_)
            if len(same):
                self.table[at, same[0]] = EMPTY
                return True
        return False

    def holds(self, hi: np.ndarray) -> np.ndarray:
        """Which keys may be in: no false negatives."""
        print_ = (hi & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        slot = ((hi >> np.uint64(16)) & np.uint64(self.mask)).astype(np.int64)
        other = (slot ^ (print_.astype(np.int64) * 0x5BD1E995)) & self.mask
        return (self.table[slot] == print_[:, None]).any(1) | (self.table[other] == print_[:, None]).any(1)

    @classmethod
    def of(cls, keys: np.ndarray, capacity: int = 0) -> CuckooFilter:
        capacity = max(capacity, len(keys), 16)
        while True:
            filter_ = cls(capacity)
            if all(filter_.insert(int(x)) for x in keys):
                return filter_
            capacity *= 2

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls(0)
        out.table = np.frombuffer(raw, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return out


def line_keys(raw: bytes | None, min_chars: int) -> tuple[list[bytes], list[int | None]]:
    """The lines of a UTF-8 text, and each line's 128-bit key (None: too short to have one)."""
    raw = raw or b""
    lines = raw.split(b"\n")
    keys: list[int | None] = []
    for low in raw.lower().split(b"\n"):
        low = low.strip(SPACE)
        long = len(low) >= min_chars and (len(low) >= 4 * min_chars or low.isascii() or len(low.decode()) >= min_chars)
        keys.append(xxhash.xxh3_128_intdigest(low) if long else None)
    return lines, keys


_LOW64 = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _references(min_chars: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), strict=True):
                id_ = i.as_py()
                for key in {k for k in line_keys(text.as_py(), min_chars)[1] if k is not None}:
                    out[0].append(id_)
                    out[1].append(_signed(key >> 64))
                    out[2].append(_signed(key & _LOW64))
                    out[3].append((key >> 64) % shards)
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "hi", "lo", "shard"])

    return run


@dataclass
class LineIndex:
    """The state of incremental line dedup; every change gives a new index and leaves this one as it was."""

    refs: DataFrame
    heavy: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 3, min_chars: int = 20, shards: int = 64) -> LineIndex:
        """Index of ``docs``. A null id counts as one document; repeated rows of an id are one document."""
        none = cls(_empty(docs, id_column), None, None, min_docs, min_chars, shards)  # type: ignore[arg-type]
        return none._change(only(docs, doc_id=id_column, text=text_column), add=True)

    def insert(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> LineIndex:
        return self._change(only(docs, doc_id=id_column, text=text_column), add=True)

    def delete(self, docs: DataFrame, id_column: str = "doc_id") -> LineIndex:
        """Without these documents, known by id; an id that is not in the index changes nothing."""
        return self._change(only(docs, doc_id=id_column), add=False)

    def _change(self, docs: DataFrame, add: bool) -> LineIndex:
        if add:
            kind = docs.schema["doc_id"].dataType
            schema = T.StructType([T.StructField("doc_id", kind), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("shard", T.IntegerType())])
            new = docs.mapInArrow(_references(self.min_chars, self.shards), schema)
            # An index of nothing takes the documents as they are; else ids that are there already count once.
            refs = new if self.heavy is None else self.refs.unionByName(new)
        else:
            gone = docs.distinct().withColumnRenamed("doc_id", "gone")
            refs = self.refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")
        refs = stage(refs, "line-refs")
        heavy = stage(self._heavy(refs), "line-heavy")
        return LineIndex(refs, heavy, self._filters(heavy), self.min_docs, self.min_chars, self.shards)

    def _heavy(self, refs: DataFrame) -> DataFrame:
        """Keys of enough documents. Ids are counted once by dropping repeats of (key, id) first, per task and then over all."""
        least = refs.groupBy("shard", "hi", "lo").agg(F.count("*").alias("rows"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        often = least.filter((F.col("rows") >= self.min_docs) & ((F.col("a") < F.col("b")) | (F.lit(self.min_docs) < 2) | F.col("a").isNull()))
        held = refs.join(often.select("shard", "hi", "lo"), ["shard", "hi", "lo"], "left_semi")
        once = held.groupBy("shard", "hi", "lo", "doc_id").agg(F.lit(1).alias("one"))
        return once.groupBy("shard", "hi", "lo").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).filter(F.col("docs") >= self.min_docs)

    def _filters(self, heavy: DataFrame) -> DataFrame:
        """(shard, filter): the old filters with the keys added that became heavy and those taken out that no longer are."""

        def make(key: tuple, table: pa.Table) -> pa.Table:
            old = [x for x in table["old"].to_pylist() if x is not None]
            hi = table["hi"].to_pylist()
            sign = table["sign"].to_pylist()
            filter_ = CuckooFilter.from_bytes(old[0]) if old else None
            now = np.array([h for h, s in zip(hi, sign, strict=True) if h is not None and s >= 0], dtype=np.int64).view(np.uint64)
            if filter_ is not None:
                for h, s in zip(hi, sign, strict=True):
                    if h is not None and s < 0:
                        filter_.delete(h & _LOW64)
                fits = all(filter_.insert(h & _LOW64) for h, s in zip(hi, sign, strict=True) if h is not None and s > 0)
                if not fits:
                    filter_ = None
            if filter_ is None:
                filter_ = CuckooFilter.of(now)
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([filter_.to_bytes()], pa.binary())], names=["shard", "filter"])

        keys = heavy.select("shard", "hi", "lo")
        if self.heavy is None:
            rows = keys.select("shard", "hi", F.lit(1).alias("sign"), F.lit(None).cast("binary").alias("old"))
        else:
            was = self.heavy.select("shard", "hi", "lo").withColumn("was", F.lit(1))
            both = keys.withColumn("now", F.lit(1)).join(was, ["shard", "hi", "lo"], "full_outer")
            change = both.select("shard", "hi", (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("sign"), F.lit(None).cast("binary").alias("old"))
            rows = change.unionByName(self.filters.select("shard", F.lit(None).cast("long").alias("hi"), F.lit(None).cast("int").alias("sign"), F.col("filter").alias("old")))
        return stage(rows.groupBy("shard").applyInArrow(make, "shard int, filter binary"), "line-filters")

    def _broadcast(self, spark: SparkSession):
        size = self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
        if size > FILTER_BYTES:
            return None
        return spark.sparkContext.broadcast({r["shard"]: CuckooFilter.from_bytes(r["filter"]) for r in self.filters.collect()})

    def drop_lines(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """(doc_id, text, n_lines, n_dropped, kept_sha256) of every row, without the lines that other documents keep.

        A line goes when at least ``min_docs`` indexed documents hold its key and the largest of their ids is not this
        row's. Rows are known by their id: insert documents before their lines are dropped. A null or empty text is one empty line; a row of null id keeps nothing on another's behalf. ``text`` is
        the text that is left, empty (not null) where no line is left; ``kept_sha256`` is of its UTF-8 bytes.
        """
        spark = docs.sparkSession
        rows = only(docs, doc_id=id_column, text=text_column)
        filters = self._broadcast(spark)
        min_chars, shards = self.min_chars, self.shards
        kind = docs.schema[id_column].dataType
        out = T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows as they come, and whether a line may be heavy."""
            for batch in batches:
                owner, his = [], []
                for i, text in enumerate(batch.column("text").cast(pa.binary())):
                    own = [k >> 64 for k in line_keys(text.as_py(), min_chars)[1] if k is not None]
                    his += own
                    owner += [i] * len(own)
                hit = np.full(batch.num_rows, filters is None)
                if filters is not None and his:
                    hi = np.array(his, dtype=np.uint64)
                    shard = (hi % np.uint64(shards)).astype(np.int64)
                    for s, filter_ in filters.value.items():
                        mine = np.flatnonzero(shard == s)
                        hit[np.array(owner)[mine[filter_.holds(hi[mine])]]] = True
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], ["doc_id", "text", "hit"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, totals, lost, digests = [], [], [], []
                for text, drops in zip(batch.column("text").cast(pa.binary()), batch.column("drops"), strict=True):
                    lines, keys = line_keys(text.as_py(), min_chars) if drops.is_valid else ((text.as_py() or b"").split(b"\n"), [])
                    kept = lines
                    if drops.is_valid:
                        gone = {((x["hi"] & _LOW64) << 64) | (x["lo"] & _LOW64) for x in drops.as_py()}
                        kept = [line for line, key in zip(lines, keys, strict=True) if key is None or key not in gone]
                    left = b"\n".join(kept)
                    texts.append(left.decode())
                    totals.append(len(lines))
                    lost.append(len(lines) - len(kept))
                    digests.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests, pa.string())], out.names)

        probed = rows.mapInArrow(probe, T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("hit", T.BooleanType())]))
        held = self.refs.join(self.heavy, ["shard", "hi", "lo"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        drops = held.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("hi", "lo")).alias("drops"))
        # Two scans of the texts, so that those without a hit are never shuffled.
        hit = probed.filter("hit").join(drops, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "drops")
        clean = probed.filter("not hit").select("doc_id", "text", F.lit(None).cast(drops.schema["drops"].dataType).alias("drops"))
        return clean.unionByName(hit).mapInArrow(cut, out)


def _empty(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.sparkSession.createDataFrame([], T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("shard", T.IntegerType())]))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Index ``docs`` and drop its repeated lines; see ``LineIndex.drop_lines``."""
    index = LineIndex.build(docs, id_column, text_column, min_docs, min_chars)
    return index.drop_lines(docs, id_column, text_column)
