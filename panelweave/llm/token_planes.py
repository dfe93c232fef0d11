"""Token files: documents as one stream of ids, cut into fixed-size blocks of bit or byte planes under zstandard.

Format: a Parquet dataset, one row per block, written in the order of (shard, block). A shard is a range of documents
by id; its ids are cut into blocks of ``block_ids`` (the last may be shorter). A row holds

* ``shard, block, first, n_ids``: place of the block and of its first id in the shard's stream: the chunk index;
* ``mode``: ``bit`` or ``byte``; ``planes``: the planes end to end, each compressed on its own, the lowest first;
  ``plane_ends``: where each ends, so that a reader can skip planes. A byte plane holds one byte of every id, a bit
  plane one bit of every id; high planes are mostly zero and almost free;
* ``docs, doc_ids, doc_counts``: the documents whose ids the block holds, as ordinals in the shard, their ids, and the
  number of ids each has in this block.

The dataset commits through Spark, so a lost or repeated task never leaves half a file, and it may live in any store.
The planes need no neighbour to be read: ``read_documents`` takes the blocks in any split, in any order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelweave.llm.common import new_path, only, shuffle_partitions
from panelweave.llm.wordhash import span_hashes, text_slices

BLOCK_IDS = 1 << 16
#: Pieces whose ids a worker keeps (beyond it forgets those not met again), and slots of the table that finds them.
CACHE_PIECES = 400_000
CACHE_SLOTS = 1 << 20
#: New words encoded together: so many bytes, or one longer word.
WORDS_BYTES = 1 << 16

# Classes of bytes: other (from 0x80 up, but letters of two bytes), letter, digit, punctuation and control, white space, the space itself.
_OTHER, _LETTER, _DIGIT, _MARK, _SPACE, _BLANK = range(6)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[:128] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[9:14] = _SPACE
_CLASS[32] = _BLANK

#: The characters by which byte-level vocabularies write the 256 bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = np.zeros(256, dtype="<u4")
_CHARS[_SHOWN] = _SHOWN
_CHARS[_CHARS == 0] = 256 + np.arange(256 - len(_SHOWN))
#: Bytes that UTF-8 never holds.
_UNUSED = [0xC0, 0xC1, *range(0xF5, 0x100)]


@cache
def _two_byte_letters() -> np.ndarray:
    """By the number of a character below 0x800: does the split of byte-level tokenizers take it for a letter?"""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False)
    return np.array([k >= 0x80 and len(split.pre_tokenize_str("a" + chr(k))) == 1 for k in range(0x800)])


def classes(raw: np.ndarray) -> np.ndarray:
    """Class of each byte; both bytes of a letter of two are letters."""
    c = _CLASS[raw]
    lead = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xDF))
    if len(lead):
        lead = lead[_two_byte_letters()[(raw[lead].astype(np.int64) & 31) << 6 | raw[lead + 1] & 63] & (raw[lead + 1] >> 6 == 2)]
        c[lead] = c[lead + 1] = _LETTER
    return c


def piece_starts(raw: np.ndarray, c: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where texts (of classes ``c``, beginning at ``begin``) can be cut so that a byte-level BPE gives their parts the same ids.

    Such a tokenizer first splits a text into runs of letters, of digits or of other marks, each with a space in front,
    contractions, and white space. A cut is made only where that split has one whatever is around it: between runs of
    different kind (not behind an apostrophe, which may start a contraction), before a space that a visible character
    follows, before white space, and behind a single white space character. White space of several characters stays
    with what follows, as its last one is split off only there. Characters here are ASCII or letters of two bytes;
    nothing is cut next to others, except before such a space.
    """
    n = len(c)
    plain = (c >= _LETTER) & (c <= _MARK)
    white = c >= _SPACE
    start = np.zeros(n, dtype=bool)
    fresh = np.zeros(n, dtype=bool)
    fresh[begin[begin < n]] = True
    if n > 1:
        a, b = c[:-1], c[1:]
        turn = plain[:-1] & (plain[1:] | (b == _SPACE)) & (a != b) & ~((raw[:-1] == 39) & (b == _LETTER))
        blank = b == _BLANK
        seen = np.zeros(n - 1, dtype=bool)
        seen[:-1] = plain[2:] & ~fresh[2:]
        turn |= blank & (seen | plain[:-1])
        lone = np.ones(n - 1, dtype=bool)
        lone[1:] = plain[:-2]
        lone |= fresh[:-1]
        turn |= (a == _SPACE) & plain[1:] & lone
        start[1:] = turn
    return np.flatnonzero(start | fresh)


def _gathered(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The spans of ``values``, end to end."""
    if not len(begin):
        return values[:0]
    size = end - begin
    to = np.cumsum(size)
    at = np.repeat(begin - (to - size), size)
    at += np.arange(len(at))
    return values[at]


class Encoder:
    """Whole texts to ids through the tokenizers library, with the ids of text pieces remembered.

    Texts are cut at ``piece_starts``, each distinct piece is encoded once, and the ids are strung together. That holds
    for byte-level BPE with its own split and no normaliser; texts of other tokenizers, and texts that spell an added
    token, are encoded whole. New words go to the library's model many at a time, between characters that no merge holds.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        self.by_piece = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not made.get("normalizer") and made["model"]["type"] == "BPE"
        self.added = [x["content"].encode() for x in made.get("added_tokens") or []]
        self.newline = self.whole(["\n"])[0]
        self.words, self.between, self.between_id = None, 0, 0
        if self.by_piece and not any(made["model"].get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            vocab = made["model"]["vocab"]
            merged = {c for pair in made["model"]["merges"] for part in pair for c in part}
            free = [b for b in _UNUSED if chr(b) in vocab and chr(b) not in merged]
            if free:
                # The same model without a split: it gets single words only, in the characters of the vocabulary.
                self.words, self.between, self.between_id = Tokenizer(self.tokenizer.model), free[-1], vocab[chr(free[-1])]
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(CACHE_SLOTS, dtype=np.uint64)
        self.codes = np.zeros(CACHE_SLOTS, dtype=np.int32)
        self.count = 0
        self.met = np.zeros(1 << 16, dtype=bool)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 16, dtype=np.int64)
        self.text = np.zeros(1 << 16, dtype=np.uint8)
        self.text_ends = np.zeros(1 << 16, dtype=np.int64)

    def forget(self) -> None:
        """Drop the pieces not met again since they came or since the last time."""
        slots = np.flatnonzero(self.keys)
        slots = slots[self.met[self.codes[slots]]]
        keys, old = self.keys[slots], self.codes[slots]
        size, length = self.ends[old + 1] - self.ends[old], self.text_ends[old + 1] - self.text_ends[old]
        ids, text = _gathered(self.ids, self.ends[old], self.ends[old + 1]), _gathered(self.text, self.text_ends[old], self.text_ends[old + 1])
        self.clear()
        self.keys[slots], self.codes[slots] = keys, self._append(ids, size, text, length)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids end to end, number of each word) of words that the split leaves whole; nothing if they can't be told apart."""
        length = ends - starts
        joined = np.full(int(length.sum()) + len(starts), self.between, dtype=np.uint8)
        joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(starts)), length)] = _gathered(raw, starts, ends)
        to = np.cumsum(length + 1)
        parts, at = [], 0
        while at < len(joined):
            stop = int(to[max(np.searchsorted(to, at + WORDS_BYTES, "right") - 1, np.searchsorted(to, at, "right"))])
            text = _CHARS[joined[at:stop]].tobytes().decode("utf-32-le")
            parts.append(np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32))
            at = stop
        ids = np.concatenate(parts)
        apart = ids == self.between_id
        at = np.flatnonzero(apart)
        return (ids[~apart], np.diff(np.r_[-1, at]) - 1) if len(at) == len(starts) else None

    def _fresh(self, raw: np.ndarray, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, number of each piece, which pieces in that order).

        A piece is a word if it has letters only or digits only, behind a space or not. Most others are encoded as the
        lines of one text: those that hold no line break and neither end nor (behind a space) begin with white space.
        """
        head = np.minimum(starts + (c[starts] == _BLANK), ends - 1)
        turns = np.zeros(len(c), dtype=np.int32)
        np.cumsum(c[1:] != c[:-1], out=turns[1:])
        word = (turns[head] == turns[ends - 1]) & ((c[head] == _LETTER) | (c[head] == _DIGIT))
        known = np.flatnonzero(word)
        got = self._words(raw, starts[known], ends[known]) if self.words is not None and len(known) else None
        if got is None:
            known = known[:0]
            got = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        other = np.delete(np.arange(len(starts)), known)
        ids, size, order = self._lines(raw, c, starts[other], ends[other], head[other])
        return np.concatenate([got[0], ids]), np.concatenate([got[1], size]), np.concatenate([known, other[order]])

    def _lines(self, raw: np.ndarray, c: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of any pieces, through the tokenizer with its split."""
        pieces = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        spaces = np.zeros(len(c) + 1, dtype=np.int32)
        np.cumsum(c == _SPACE, out=spaces[1:])
        line = (spaces[starts] == spaces[ends]) & (c[head] != _BLANK) & (c[ends - 1] != _BLANK)
        for i in np.flatnonzero(line & ((c[head] == _OTHER) | (c[ends - 1] == _OTHER))):
            text = pieces[i].decode()
            line[i] = not (text[-1].isspace() or text[text[0] == " "].isspace())
        order = np.flatnonzero(line)
        ids, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(order):
            ids = np.array(self.whole([b"\n".join([pieces[i] for i in order]).decode()])[0], dtype=np.uint32)
            at = np.flatnonzero(ids == self.newline[0])
            if len(self.newline) == 1 and len(at) == len(order) - 1:
                size = np.diff(np.r_[-1, at, len(ids)]) - 1
                ids = np.delete(ids, at)
            else:
                order, ids, line = order[:0], ids[:0], np.zeros_like(line)
        rest = np.flatnonzero(~line)
        own = self.whole([pieces[i].decode() for i in rest]) if len(rest) else []
        return np.concatenate([ids, np.array([i for x in own for i in x], dtype=np.uint32)]), np.concatenate([size, np.array([len(x) for x in own], dtype=np.int64)]), np.concatenate([order, rest])

    def _append(self, ids: np.ndarray, size: np.ndarray, text: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, after storing their ids and bytes."""
        n, end, at = self.count, int(self.ends[self.count]), int(self.text_ends[self.count])
        while end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(text) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while n + len(size) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.text_ends = np.concatenate([self.text_ends, np.zeros_like(self.text_ends)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        self.ids[end : end + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(size)] = end + np.cumsum(size)
        self.text[at : at + len(text)] = text
        self.text_ends[n + 1 : n + 1 + len(size)] = at + np.cumsum(length)
        self.count = n + len(size)
        return np.arange(n, self.count, dtype=np.int32)

    def _remember(self, keys: np.ndarray, codes: np.ndarray) -> None:
        """Give new pieces a slot; a piece whose two slots are taken is used now and encoded again next time."""
        left = np.arange(len(keys))
        for slot in self._slots(keys):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.codes[slot[put]] = keys[put], codes[put]
            left = left[self.keys[slot[left]] != keys[left]]

    @staticmethod
    def _slots(keys: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(CACHE_SLOTS - 1)
        return [(keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)]

    def _codes(self, raw: np.ndarray, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each piece in the memory, after encoding the new ones."""
        keys = span_hashes(raw, starts, ends) + (ends - starts).astype(np.uint64)
        keys[keys == 0] = 1
        code = np.full(len(keys), -1, dtype=np.int32)
        open_ = np.arange(len(keys))
        for slot in self._slots(keys):
            same = self.keys[slot[open_]] == keys[open_]
            hit = open_[same]
            code[hit] = self.codes[slot[hit]]
            open_ = open_[~same]
        self.met[code[code >= 0]] = True
        if len(open_):
            new, first, which = np.unique(keys[open_], return_index=True, return_inverse=True)
            where = open_[first]
            ids, size, order = self._fresh(raw, c, starts[where], ends[where])
            where = where[order]
            own = np.empty(len(new), dtype=np.int32)
            own[order] = self._append(ids, size, _gathered(raw, starts[where], ends[where]), ends[where] - starts[where])
            self._remember(new[order], own[order])
            code[open_] = own[which]
        return self._confirmed(code, raw, c, starts, ends)

    def _confirmed(self, code: np.ndarray, raw: np.ndarray, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``code`` with every piece whose bytes are not those remembered (equal hashes) encoded anew. Pieces tile ``raw``."""
        begin, end = self.text_ends[code], self.text_ends[code + 1]
        wrong = (end - begin) != (ends - starts)
        if not wrong.any():
            other = _gathered(self.text, begin, end) != raw
            if not other.any():
                return code
            wrong = np.logical_or.reduceat(other, starts)
        else:
            wrong = np.array([not np.array_equal(self.text[a:b], raw[s:e]) for a, b, s, e in zip(begin, end, starts, ends, strict=True)])
        at = np.flatnonzero(wrong)
        ids, size, order = self._fresh(raw, c, starts[at], ends[at])
        at = at[order]
        code[at] = self._append(ids, size, _gathered(raw, starts[at], ends[at]), ends[at] - starts[at])
        return code

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each text) of the texts between the offsets."""
        data = None
        apart = np.zeros(len(off) - 1, dtype=bool)
        if not self.by_piece or any(x in raw.tobytes() for x in self.added):
            data = raw.tobytes()
            apart = np.array([not self.by_piece or any(x in data[a:b] for x in self.added) for a, b in zip(off[:-1], off[1:], strict=True)], dtype=bool)
        if self.count > CACHE_PIECES:
            self.forget()
        c = classes(raw)
        starts = piece_starts(raw, c, off[:-1][np.diff(off) > 0]) if self.by_piece and len(raw) else np.zeros(0, np.int64)
        code = self._codes(raw, c, starts, np.r_[starts[1:], len(raw)]) if len(starts) else np.zeros(0, np.int64)
        begin, end = self.ends[code], self.ends[code + 1]
        ids = _gathered(self.ids, begin, end)
        edges = np.r_[0, np.cumsum(end - begin)][np.searchsorted(starts, off)]
        if not apart.any():
            return ids, np.diff(edges)
        parts = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        rows = np.flatnonzero(apart)
        for k, own in zip(rows, self.whole([data[off[k] : off[k + 1]].decode() for k in rows]), strict=True):
            parts[k] = np.array(own, dtype=np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def to_planes(ids: np.ndarray, mode: str = "byte", level: int = 3) -> tuple[bytes, list[int]]:
    """Compressed planes of 32-bit ids, lowest first, and where each ends."""
    table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    press = zstandard.ZstdCompressor(level=level)
    parts = []
    for byte in range(4):
        plane = np.ascontiguousarray(table[:, byte])
        if mode == "byte":
            parts.append(press.compress(plane.tobytes()))
        else:
            bits = np.unpackbits(plane.reshape(-1, 1), axis=1, bitorder="little")
            parts += [press.compress(np.packbits(bits[:, k], bitorder="little").tobytes()) for k in range(8)]
    return b"".join(parts), np.cumsum([len(x) for x in parts]).tolist()


def from_planes(planes: bytes, ends: list[int], n: int, mode: str) -> np.ndarray:
    """The ids of a block."""
    open_ = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(open_.decompress(planes[a:b]), dtype=np.uint8) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    if mode == "byte":
        return np.stack(parts, axis=1).reshape(-1).view("<u4")
    table = np.zeros((n, 4), dtype=np.uint8)
    for byte in range(4):
        bits = np.stack([np.unpackbits(parts[8 * byte + k], count=n, bitorder="little") for k in range(8)], axis=1)
        table[:, byte] = np.packbits(bits, axis=1, bitorder="little").ravel()
    return table.reshape(-1).view("<u4")


def _block_schema(kind: T.DataType) -> T.StructType:
    fields = [("shard", T.IntegerType()), ("block", T.LongType()), ("first", T.LongType()), ("n_ids", T.LongType()), ("mode", T.StringType()), ("planes", T.BinaryType()), ("plane_ends", T.ArrayType(T.LongType())), ("docs", T.ArrayType(T.LongType())), ("doc_ids", T.ArrayType(kind)), ("doc_counts", T.ArrayType(T.LongType()))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _writer(tokenizer: str, end_id: int, block_ids: int, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        held: list[np.ndarray] = []
        owners: list[tuple[int, object, int]] = []
        full = made = block = ordinal = 0
        kind = None

        def row(ids: np.ndarray, own: list) -> pa.RecordBatch:
            planes, ends = to_planes(ids, mode)
            cells = [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([made], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([mode]), pa.array([planes], pa.binary()), pa.array([ends], pa.list_(pa.int64())), pa.array([[x[0] for x in own]], pa.list_(pa.int64())), pa.array([[x[1] for x in own]], pa.list_(kind)), pa.array([[x[2] for x in own]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cells, ["shard", "block", "first", "n_ids", "mode", "planes", "plane_ends", "docs", "doc_ids", "doc_counts"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            names = batch.column("doc_id").to_pylist()
            for rows, raw, off in text_slices(batch.column("text")):
                ids, sizes = encode.encode(raw, off)
                ends = np.cumsum(sizes)
                # The end id goes behind each document.
                ids = np.insert(ids, ends, np.uint32(end_id))
                at = 0
                for name, size in zip(names[rows], (sizes + 1).tolist(), strict=True):
                    left = size
                    while left:
                        take = min(left, block_ids - full)
                        owners.append((ordinal, name, take))
                        held.append(ids[at : at + take])
                        at, left, full = at + take, left - take, full + take
                        if full == block_ids:
                            yield row(np.concatenate(held), owners)
                            made, block, full, held, owners = made + full, block + 1, 0, [], []
                    ordinal += 1
        if full:
            yield row(np.concatenate(held), owners)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", block_ids: int = BLOCK_IDS, mode: str = "byte", shards: int | None = None) -> None:
    """Write ``docs`` in ascending id order (null ids first, rows of one id by a hash of their text) to ``path``.

    Every row is written, repeated ones too; a null or empty text is the end id alone. No rows: a dataset without
    blocks. Shards are ranges of (id, hash), so even rows that all share an id are split.
    """
    if mode not in ("bit", "byte"):
        raise ValueError(f"mode {mode!r} is neither bit nor byte")
    kind = docs.schema[id_column].dataType
    rows = only(docs, doc_id=id_column, text=text_column).withColumn("th", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards or shuffle_partitions(docs.sparkSession), "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    rows.mapInArrow(_writer(tokenizer, end_id, block_ids, mode), _block_schema(kind)).write.option("compression", "none").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, start, n_ids) of every block, ``start`` in the stream of all shards; reads no planes."""
    blocks = spark.read.parquet(path).select("shard", "block", "first", "n_ids")
    return blocks.join(_shard_starts(blocks), "shard").select("shard", "block", (F.col("first") + F.col("base")).alias("start"), "n_ids")


def _shard_starts(blocks: DataFrame) -> DataFrame:
    """A row per shard: the ids of all shards before it."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    return totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))


def _crc_joined(pieces: list) -> int:
    """CRC-32 of strings end to end from their (crc, bytes): shifting by a string's length is a matrix over GF(2)."""

    def times(matrix: list[int], vector: int) -> int:
        total, k = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[k]
            vector >>= 1
            k += 1
        return total

    total = 0
    for crc, size in pieces:
        step = [0xEDB88320, *[1 << k for k in range(31)]]  # one zero bit
        bits = 8 * size
        while bits:
            if bits & 1:
                total = times(step, total)
            step = [times(step, x) for x in step]
            bits >>= 1
        total ^= crc
    return total


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the blocks: each block is decoded on its own."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = from_planes(b["planes"], b["plane_ends"], b["n_ids"], b["mode"])
                edges = np.r_[0, np.cumsum(b["doc_counts"])]
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                k = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, b["shard"], np.int32)), pa.array(b["docs"], pa.int64()), pa.array(b["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(b["first"] + edges[:-1]), pa.array(b["doc_counts"], pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc", "doc_id", "at", "n", "crc"])

    @F.pandas_udf(T.LongType())
    def whole(parts):
        return parts.map(lambda x: None if x is None else _crc_joined([(p["crc"], 4 * p["n"]) for p in x])).astype("Int64")

    fields = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("doc_id", kind), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])
    got = blocks.mapInArrow(pieces, fields)
    docs = got.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "crc", "n"))).alias("parts"))
    docs = docs.join(_shard_starts(blocks.select("shard", "n_ids")), "shard")
    base = docs.select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "parts")
    # Few documents lie in several blocks; only their pieces go to Python.
    several = whole(F.when(F.size("parts") > 1, F.col("parts")))
    return base.select("doc_id", "start", "n_tokens", F.coalesce(several, F.col("parts")[0]["crc"]).alias("ids_crc32"))


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", mode: str = "byte") -> DataFrame:
    """Write the token files in a new folder of the shared one and read every document back from them."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, id_column, text_column, mode=mode)
    return read_documents(docs.sparkSession, path)
