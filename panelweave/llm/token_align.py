"""Cross-tokenizer alignment: where two tokenizers cut the same bytes, which of their tokens overlap, and how often.

Arrow columns from end to end; every step works on the flat tokens of a slice of documents.

1. A slice's texts are encoded by both tokenizers. The lists are flattened, with the document of every token as parent
   index. Taking each id's bytes from the vocabulary gives the tokens end to end; documents whose bytes differ from the
   text are left out.
2. Cumulative sums of the token lengths, segmented by document, give token ends. A full outer hash join of A's ends with
   B's on (document, end) has a row for every stretch between neighbouring cuts: a row of both sides ends a *group*; every
   row is one *link*, as two tokens overlap in exactly one stretch.
3. ``align`` keeps the ids and, for every stretch, who ends there: all links follow from these by running counts.
4. ``pair_counts`` counts the documents of each linked id pair: partial counts by ``Table.group_by`` in each task,
   merged by Spark. ``link_scores`` looks every link's pair up in that table.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import only, stage

#: Bytes of text whose tokens are aligned at a time (or one longer document).
SLICE_BYTES = 1 << 19
#: Staged documents whose links are unfolded at a time, by tokens.
SLICE_TOKENS = 1 << 20
#: The table of pair counts is sent to the tasks up to this size (17 bytes a pair); beyond it the links are joined.
TABLE_BYTES = 64 << 20
PAIR_BYTES = 17

#: Units whose ids a worker keeps, and their ids.
MEMORY_UNITS = 400_000
MEMORY_IDS = 4_000_000

ENDS_A, ENDS_B = 1, 2
#: Bits of a token's end in its key; the rest is the document in the slice.
END_BITS = 40


def _byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


class ByteLevel:
    """A tokenizer file of the tokenizers library with a byte-level vocabulary; texts come with their space in front.

    ``by_unit``: it splits texts by its own pattern before anything else, so texts may be encoded in units.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        self.by_unit = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
        of = _byte_level()
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.bytes = [bytes(of[c] for c in names[i]) if i in names and all(c in of for c in names[i]) else b"" for i in range(max(names) + 1)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each). Units that are one space and visible ends are encoded as the lines of one text.

        A line break between a visible character and a space that a visible one follows is a token of its own.
        """
        line = np.array([len(t) > 1 and t[0] == " " and not (t[1].isspace() or t[-1].isspace() or "\n" in t) for t in texts], dtype=bool)
        break_ = self.encode(["\n"])[0]
        joined = np.array(self.encode(["\n".join([t for t, x in zip(texts, line, strict=True) if x])])[0], dtype=np.int32) if line.any() else np.zeros(0, np.int32)
        at = np.flatnonzero(joined == break_[0])
        if len(break_) != 1 or len(at) != max(int(line.sum()) - 1, 0):
            return _flat(self.encode(texts))
        size = np.zeros(len(texts), dtype=np.int64)
        if line.any():
            size[line] = np.diff(np.r_[-1, at, len(joined)]) - 1
        other, size[~line] = _flat(self.encode([t for t, x in zip(texts, line, strict=True) if not x]))
        whole = np.repeat(line, size)
        ids = np.empty(len(whole), dtype=np.int32)
        ids[whole], ids[~whole] = np.delete(joined, at), other
        return ids, size


class Pieces:
    """A sentencepiece model. It puts a space before every text itself, so texts, which come with one, lose theirs.

    ``by_unit``: no piece has a space behind another character, and none is matched ahead of the merges.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in ids]
        self.by_unit = not any("▁" in n.lstrip("▁") or self.model.is_unused(i) for i, n in zip(ids, names, strict=True)) and self.model.encode("x <s> y") == self.model.encode("x") + self.model.encode("<s>") + self.model.encode("y")
        self.lone = [self.model.piece_to_id("▁")]  # a lone space: the library gives an empty text no tokens
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids, names, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        got = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [self.lone if t == " " else x for t, x in zip(texts, got, strict=True)]

    def encode_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.encode(texts))


_LOADED: dict[str, ByteLevel | Pieces] = {}


def load(path: str) -> ByteLevel | Pieces:
    """One for each file and Python worker; ``.json`` is a file of the tokenizers library, all else a sentencepiece model."""
    if path not in _LOADED:
        _LOADED[path] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return _LOADED[path]


def id_kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


@dataclass
class Side:
    """The flat tokens of one tokenizer: ids, the document of each, and where each ends in its document."""

    ids: np.ndarray
    doc: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, doc: np.ndarray, vocabulary: pa.Array) -> tuple[Side, pa.Array]:
        tokens = pc.take(vocabulary, pa.array(ids))
        size = pc.binary_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        base = np.repeat(total[first] - size[first], np.diff(np.r_[first, len(doc)]))
        return cls(ids, doc, total - base), tokens

    def table(self, name: str) -> pa.Table:
        """The document and end of every token in one key."""
        return pa.table({"end": (self.doc.astype(np.int64) << END_BITS) | self.end, name: np.ones(len(self.doc), dtype=bool)})


def _units(raw: np.ndarray, off: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts (each with a space in front) cut before every space behind a visible ASCII character, and their documents.

    Neither a byte-level split nor a piece reaches over such a place, and what follows it is cut as at the start of a text.
    """
    cut = np.zeros(len(raw), dtype=bool)
    cut[1:] = (raw[1:] == 32) & (raw[:-1] > 32) & (raw[:-1] < 127)
    cut[off[:-1]] = True
    starts = np.flatnonzero(cut)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(raw)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    return units.dictionary_encode(), np.searchsorted(off, starts, "right") - 1


class Memory:
    """The ids that some tokenizers give units seen before, end to end; begun anew beyond ``MEMORY_UNITS`` or ``MEMORY_IDS``."""

    def __init__(self, sides: list[ByteLevel | Pieces]) -> None:
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.ids, self.ends = [np.zeros(0, np.int32) for _ in self.sides], [np.zeros(1, np.int64) for _ in self.sides]

    def look(self, units: list[bytes]) -> np.ndarray:
        """The number of each unit (distinct ones), after encoding the new ones."""
        if len(self.code) > MEMORY_UNITS or any(len(x) > MEMORY_IDS for x in self.ids):
            self.clear()
        new = [u for u in units if u not in self.code]
        if new:
            texts = b"\0".join(new).decode().split("\0") if not any(0 in u for u in new) else [u.decode() for u in new]
            for k, side in enumerate(self.sides):
                ids, size = side.encode_units(texts)
                self.ids[k] = np.concatenate([self.ids[k], ids])
                self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(size)])
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        return np.fromiter(map(self.code.__getitem__, units), np.int64, len(units))

    def lists(self, side: ByteLevel | Pieces, codes: np.ndarray) -> pa.LargeListArray:
        """The ids of each unit, in order."""
        k = self.sides.index(side)
        begin = self.ends[k][codes]
        ends = np.cumsum(self.ends[k][codes + 1] - begin)
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        at = np.repeat(begin - starts, ends - starts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return pa.LargeListArray.from_arrays(pa.array(np.r_[0, ends]), pa.array(self.ids[k][at]))


_MEMORY: dict[tuple[int, ...], Memory] = {}


def _encoded(sides: tuple[ByteLevel | Pieces, ...], spaced: list[str], raw: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids end to end, document of each) of every tokenizer. Equal units have equal ids and are encoded once."""
    split = [side for side in sides if side.by_unit]
    memory = _MEMORY.setdefault(tuple(map(id, split)), Memory(split))
    units, of_doc = _units(raw, off)
    codes = memory.look(units.dictionary.to_pylist())[units.indices.to_numpy()] if split else None
    out = []
    for side in sides:
        if side.by_unit:
            lists, parent = memory.lists(side, codes), of_doc
        else:
            lists, parent = pa.array(side.encode(spaced), pa.large_list(pa.int32())), np.arange(len(spaced))
        out.append((pc.list_flatten(lists).to_numpy(zero_copy_only=False), parent[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)]))
    return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    column = pa.array(lists, pa.list_(pa.int32()))
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _raw(tokens: pa.Array) -> np.ndarray:
    """The bytes of a binary column, end to end."""
    _, offsets, data = tokens.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(tokens) else np.zeros(0, np.uint8)


def _sound(side: Side, tokens: pa.Array, want: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which documents' tokens, end to end, are the bytes wanted."""
    n = len(off) - 1
    # An id without bytes of its own (a special token) is no token of a text.
    empty = np.bincount(side.doc[pc.equal(pc.binary_length(tokens), 0).to_numpy(zero_copy_only=False)], minlength=n) > 0
    size = np.zeros(n, dtype=np.int64)
    np.maximum.at(size, side.doc, side.end)
    good = (size == np.diff(off)) & ~empty
    got, edges = _raw(tokens), np.r_[0, np.cumsum(size)]
    if good.all() and np.array_equal(got, want):
        return good
    for d in np.flatnonzero(good):
        good[d] = np.array_equal(got[edges[d] : edges[d + 1]], want[off[d] : off[d + 1]])
    return good


def _joined_ids(ids: np.ndarray, cut: np.ndarray, names: pa.Array) -> pa.Array:
    """The ids between the cuts in decimal, joined by commas: a string for each group."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pc.take(names, pa.array(ids))), ",")


def _align_slice(texts: list[str], a: ByteLevel | Pieces, b: ByteLevel | Pieces, vocabularies: tuple[pa.Array, pa.Array], names: pa.Array) -> dict[str, list]:
    """The alignment of non-empty texts."""
    spaced = [" " + t for t in texts]
    want = pa.array(spaced, pa.large_string()).cast(pa.large_binary())
    off = np.r_[0, np.cumsum(pc.binary_length(want).to_numpy(zero_copy_only=False))].astype(np.int64)
    raw = _raw(want)
    flat = _encoded((a, b), spaced, raw, off)
    sides = [Side.of(*x, v) for x, v in zip(flat, vocabularies, strict=True)]
    good = _sound(*sides[0], raw, off) & _sound(*sides[1], raw, off)
    if not good.all():
        sides = [Side.of(ids[good[doc]], doc[good[doc]], v) for (ids, doc), v in zip(flat, vocabularies, strict=True)]
    left, right = sides[0][0], sides[1][0]
    n = len(texts)

    cuts = left.table("a").join(right.table("b"), "end", join_type="full outer", use_threads=False)
    end = cuts["end"].to_numpy()
    steps = cuts["a"].is_valid().to_numpy() * np.uint8(ENDS_A) + cuts["b"].is_valid().to_numpy() * np.uint8(ENDS_B)
    order = np.argsort(end, kind="stable")
    doc, steps = end[order] >> END_BITS, steps[order].astype(np.uint8)

    both = steps == ENDS_A | ENDS_B
    cut_a, cut_b = (np.r_[0, np.cumsum((steps & bit) > 0)[both]] for bit in (ENDS_A, ENDS_B))
    groups = pc.binary_join_element_wise(_joined_ids(left.ids, cut_a, names), _joined_ids(right.ids, cut_b, names), "|")
    of_doc = np.searchsorted(doc[both], np.arange(n + 1))
    texts_of = pc.binary_join(pa.ListArray.from_arrays(pa.array(of_doc, pa.int32()), groups), ";")
    digest = [hashlib.sha256(memoryview(x.as_buffer())).hexdigest() if g else "" for x, g in zip(texts_of, good, strict=True)]

    edges = [np.searchsorted(x, np.arange(n + 1)) for x in (left.doc, right.doc, doc)]
    parts = [left.ids.astype(id_kind(len(a.bytes))), right.ids.astype(id_kind(len(b.bytes))), steps]
    packed = [[x[s:t].tobytes() for s, t in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)] for x, e in zip(parts, edges, strict=True)]
    return {
        "n_a": np.diff(edges[0]), "n_b": np.diff(edges[1]), "n_groups": np.diff(of_doc), "n_links": np.diff(edges[2]),
        "groups_sha256": digest, "a_ids": packed[0], "b_ids": packed[1], "steps": packed[2],
    }


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_PACKED = ["a_ids", "b_ids", "steps"]


def align(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The alignment of every row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and packed a_ids, b_ids, steps.

    ``a_ids`` and ``b_ids`` are little-endian ids (two bytes each; four for vocabularies above 65,536). ``steps`` has a byte
    for each link in order: 1 where A's token ends there, 2 where B's does, 3 where both do, which ends a group. Special
    tokens are neither added nor recognised. Null and empty texts, and texts that a tokenizer does not keep byte by byte,
    have no tokens: zeros, an empty digest and empty packs. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        a, b = load(a_path), load(b_path)
        vocabularies = tuple(pa.array(x.bytes, pa.large_binary()) for x in (a, b))
        names = pa.array(range(max(len(a.bytes), len(b.bytes)))).cast(pa.string())
        for batch in batches:
            texts = batch.column("text")
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.cumsum(size, dtype=np.int64)]
            at = 0
            while at < batch.num_rows:
                to = min(max(int(np.searchsorted(edges, edges[at] + SLICE_BYTES, "right")) - 1, at + 1), batch.num_rows)
                full = np.flatnonzero(size[at:to])
                got = _align_slice([texts[at + int(k)].as_py() for k in full], a, b, vocabularies, names) if len(full) else {}
                columns = [batch.column("doc_id").slice(at, to - at)]
                for c in _NUMBERS:
                    x = np.zeros(to - at, dtype=np.int64)
                    if got:
                        x[full] = got[c]
                    columns.append(pa.array(x))
                for c in ["groups_sha256", *_PACKED]:
                    none, kind = ("", pa.string()) if c == "groups_sha256" else (b"", pa.binary())
                    x = [none] * (to - at)
                    for k, value in zip(full.tolist(), got.get(c, []), strict=True):
                        x[k] = value
                    columns.append(pa.array(x, kind))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_NUMBERS, "groups_sha256", *_PACKED])
                at = to

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", groups_sha256 string, " + ", ".join(f"{c} binary" for c in _PACKED)
    return only(docs, doc_id=id_column, text=text_column).mapInArrow(run, schema)


def _links(batch: pa.RecordBatch, kinds: tuple[str, str], width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, links of each, pair of each link) of runs of rows; a pair is ``a * width + b``."""
    columns = [batch.column(c) for c in _PACKED]
    n = pc.binary_length(columns[2]).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.r_[0, np.cumsum(n)]
    at = 0
    while at < batch.num_rows:
        to = min(max(int(np.searchsorted(edges, edges[at] + SLICE_TOKENS, "right")) - 1, at + 1), batch.num_rows)
        a, b, steps = (
            np.frombuffer(b"".join(c.slice(at, to - at).to_pylist()), dtype=kind) for c, kind in zip(columns, (*kinds, "u1"), strict=True)
        )
        # The tokens that lie over a stretch are those after the ends before it; a document's last stretch ends both.
        over_a, over_b = (np.cumsum((steps & bit) > 0) - ((steps & bit) > 0) for bit in (ENDS_A, ENDS_B))
        yield slice(at, to), n[at:to], a[over_a].astype(np.int64) * width + b[over_b]
        at = to


def links(aligned: DataFrame, a_size: int, b_size: int) -> DataFrame:
    """(row, pair, times): every row's distinct linked pairs; ``aligned`` has a long ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy(zero_copy_only=False)
            for rows, n, pairs in _links(batch, (id_kind(a_size), id_kind(b_size)), b_size):
                t = pa.table({"row": np.repeat(row[rows], n), "pair": pairs}).group_by(["row", "pair"], use_threads=False).aggregate([([], "count_all")])
                yield from t.select(["row", "pair", "count_all"]).rename_columns(["row", "pair", "times"]).to_batches()

    return aligned.select("row", *_PACKED).mapInArrow(run, "row long, pair long, times long")


def pair_counts(aligned: DataFrame, a_size: int, b_size: int) -> DataFrame:
    """(pair, docs, best): in how many rows each pair is linked, and whether that is the most that its A id has (ties too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("docs", "sum")]).rename_columns(["pair", "docs"])

        for batch in batches:
            for _, n, pairs in _links(batch, (id_kind(a_size), id_kind(b_size)), b_size):
                once = pa.table({"doc": np.repeat(np.arange(len(n)), n), "pair": pairs}).group_by(["doc", "pair"], use_threads=False).aggregate([])
                held.append(once.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "docs"]))
                if len(held) > 1 and sum(len(t) for t in held) > 1 << 20:
                    held = [merged()]
                    if len(held[0]) > 1 << 19:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    counts = stage(aligned.select(*_PACKED).mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    a_id = F.floor(F.col("pair") / b_size)
    top = counts.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("top"))
    return stage(counts.withColumn("a_id", a_id).join(top, "a_id").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")), "pair-counts")


def link_scores(aligned: DataFrame, counts: DataFrame, a_size: int, b_size: int, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``aligned`` without its packs, with n_best (links whose pair is its A id's best) and count_sum (documents, over links)."""
    kept = [c for c in aligned.columns if c not in (*_PACKED, "row")]
    if counts.count() * PAIR_BYTES > table_bytes:
        got = links(aligned, a_size, b_size).join(counts, "pair").groupBy("row")
        got = got.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum"))
        rows = aligned.select("row", *kept).join(got, "row", "left")
        return rows.select(*kept, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])
    table = counts.toArrow().sort_by("pair")
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "docs", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = shared.value
        for batch in batches:
            out = np.zeros((2, batch.num_rows), dtype=np.int64)
            for rows, n, pairs in _links(batch, (id_kind(a_size), id_kind(b_size)), b_size):
                at = np.searchsorted(pair, pairs)
                total = np.r_[0, np.cumsum(best[at])], np.r_[0, np.cumsum(docs[at])]
                edges = np.r_[0, np.cumsum(n)]
                for k in range(2):
                    out[k, rows] = np.diff(total[k][edges])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out[0]), pa.array(out[1])], [*kept, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)
    return aligned.select(*kept, *_PACKED).mapInArrow(run, f"{schema}, n_best long, count_sum long")


def alignment_report(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row, repeated rows included."""
    sizes = [len(load(p).bytes) for p in (a_path, b_path)]
    aligned = align(docs, a_path, b_path, id_column, text_column)
    aligned = stage(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    return link_scores(aligned, pair_counts(aligned, *sizes), *sizes, table_bytes)
