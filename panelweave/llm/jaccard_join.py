"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Every text becomes the set of its five-word shingles (64-bit hashes). Texts with equal sets form one *class* at once;
all later work is between classes, so copies are never expanded into pairs.

1. ``_cut``: each task hashes its texts and sends packed blocks (class ids, set sizes, 40-bit tokens) to token buckets.
   A task sends a class once, however many copies it holds.
2. ``_count``: a bucket counts each token's classes. Tokens of one class can never meet another set: they are counted,
   not sent on. Shared tokens go back to their class with their frequency.
3. ``_order``: a class orders its tokens by (frequency, token); the unshared ones come first and fill the prefix. A
   class whose prefix holds no shared token has no partner. The others are staged with their ordered tokens.
4. Prefix tokens are joined. Two sets x, y can only link when their sizes allow it (length), when enough tokens are left
   after the common one (positional) and when the counts of tokens by hashed part allow it (suffix). Each pair that is
   left is verified once, on whole sets.

A group of thousands of near copies shares whole prefixes, so joining everything at once would emit its square. The
join therefore runs in rounds: a class meets a few others of each prefix list only, links contract classes to components,
and only classes of different components meet again. The last round joins every pair that is
still in different components, so no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelweave.llm.common import free_names, joined, only, pack5, q, shuffle_partitions, stage, unpack5
from panelweave.llm.components import connected_components
from panelweave.llm.wordhash import Words, mix64, shingle_hashes, words_of

#: Tokens that a task gathers before it sends blocks.
BLOCK_TOKENS = 1_000_000
#: Parts of the suffix filter, whose counts share a long, a byte each; a count of ``FULL`` or more gives no bound.
PARTS = 8
FULL = 255
#: Contracting rounds go on while prefix lists hold more unsettled pairs per class, and links are still found.
PAIRS_PER_CLASS = 4
MAX_ROUNDS = 6
#: Rows of a prefix list's largest component that the other rows of the list meet in a round.
REPRESENTATIVES = 2


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, first, class id): each document's sorted distinct shingles end to end, and a hash of the set (0: empty)."""
    counts = words.counts
    tokens = shingle_hashes(words.hashes, size)
    docs = np.repeat(np.arange(len(counts)), counts)
    whole = docs[: len(tokens)] == docs[size - 1 :] if len(tokens) else np.zeros(0, bool)
    tokens, docs = tokens[whole], docs[: len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        alone = np.array([shingle_hashes(words.hashes[words.first[d] : words.first[d + 1]], counts[d])[0] + np.uint64(counts[d]) for d in short], dtype=np.uint64)
        docs = np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        tokens, docs = np.concatenate([tokens, mix64(alone)])[order], docs[order]
    first = np.searchsorted(docs, np.arange(len(counts) + 1))
    for a, b in zip(first[:-1], first[1:], strict=True):
        tokens[a:b].sort()
    keep = np.ones(len(tokens), dtype=bool)
    keep[1:] = (tokens[1:] != tokens[:-1]) | (docs[1:] != docs[:-1])
    tokens, docs = tokens[keep], docs[keep]
    first = np.searchsorted(docs, np.arange(len(counts) + 1))
    total = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(mix64(tokens + np.uint64(0xA0761D6478BD642F)), out=total[1:])
    n = np.diff(first)
    ids = mix64(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))
    ids[n == 0] = 0
    return tokens, first, ids


def _classes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for words in words_of(batch.column("text")):
                _, first, own = shingle_sets(words, size)
                ids.append(own)
                sizes.append(np.diff(first))
            kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text" or batch.schema.names.index("text") != i]
            names = [f.name for f in batch.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(ids).view(np.int64)), pa.array(np.concatenate(sizes).astype(np.int64))], [*names, "cls", "n"])

    return run


_BLOCK = "classes binary, sizes binary, counts binary, tokens binary"


def _cut(size: int, buckets: int):
    """Texts to blocks of tokens, a block for each bucket that gets any."""

    def blocks(held: list) -> Iterator[pa.RecordBatch]:
        tokens, ids, sizes = (np.concatenate([x[i] for x in held]) for i in range(3))
        owner = np.repeat(np.arange(len(ids)), sizes)
        bucket = (tokens >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        tokens, owner, bucket = tokens[order], owner[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows: list[tuple] = []
        for k in np.flatnonzero(np.diff(edges)):
            part = slice(edges[k], edges[k + 1])
            start = np.flatnonzero(np.r_[True, owner[part][1:] != owner[part][:-1]])
            who = owner[part][start]
            rows.append((int(k), ids[who].tobytes(), sizes[who].astype("<u4").tobytes(), np.diff(np.r_[start, edges[k + 1] - edges[k]]).astype("<u4").tobytes(), pack5(tokens[part])))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], ["bucket", "classes", "sizes", "counts", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = {0}
        held: list = []
        full = 0
        for batch in batches:
            for words in words_of(batch.column("text")):
                tokens, first, ids = shingle_sets(words, size)
                new = []
                for i, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new.append(i)
                if not new:
                    continue
                n = np.diff(first)
                fresh = np.zeros(len(ids), dtype=bool)
                fresh[new] = True
                held.append((tokens[np.repeat(fresh, n)], ids[fresh], n[fresh]))
                full += int(n[fresh].sum())
                if full >= BLOCK_TOKENS:
                    yield from blocks(held)
                    held, full = [], 0
        if held:
            yield from blocks(held)

    return run


def _blocks_in(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class ids, set sizes, owner of each token as index of the former, blocks' rows of each token)."""
    classes, _ = joined(table["classes"], "<u8")
    sizes, _ = joined(table["sizes"], "<u4")
    counts, per_row = joined(table["counts"], "<u4")
    owner = np.repeat(np.arange(len(classes)), counts)
    row = np.repeat(np.arange(len(per_row)), per_row)
    return classes, sizes, owner, np.repeat(row, counts)


def _count(parts: int):
    """One bucket: keep tokens of two classes or more, with a frequency on a scale of eight steps per doubling."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        classes, sizes, owner, _ = _blocks_in(table)
        tokens = np.concatenate([unpack5(x) for x in table["tokens"].to_pylist()])
        del table
        known, same = np.unique(classes, return_inverse=True)
        size_of = np.zeros(len(known), dtype=np.uint32)
        size_of[same] = sizes
        who = same[owner].astype(np.uint32)

        def shared(t: np.ndarray) -> np.ndarray:
            start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, int)
            run = np.diff(np.r_[start, len(t)])
            return np.repeat(run, run)

        order = np.argsort(tokens)
        tokens, who = tokens[order], who[order]
        more = shared(tokens) > 1
        tokens, who = tokens[more], who[more]
        order = np.lexsort((who, tokens))
        tokens, who = tokens[order], who[order]
        keep = np.ones(len(tokens), dtype=bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (who[1:] != who[:-1])
        tokens, who = tokens[keep], who[keep]
        often = shared(tokens)
        more = often > 1
        tokens, who, often = tokens[more], who[more], often[more]
        scale = np.minimum(255, np.floor(8 * np.log2(np.maximum(often, 1)))).astype(np.uint8)
        part = (known[who] % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((who, part))
        tokens, who, scale, part = tokens[order], who[order], scale[order], part[order]
        edges = np.searchsorted(part, np.arange(parts + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edges)):
            own = slice(edges[k], edges[k + 1])
            start = np.flatnonzero(np.r_[True, who[own][1:] != who[own][:-1]])
            ids = who[own][start]
            rows.append((int(k), bucket, known[ids].tobytes(), size_of[ids].tobytes(), np.diff(np.r_[start, edges[k + 1] - edges[k]]).astype("<u4").tobytes(), pack5(tokens[own]), scale[own].tobytes()))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=["part", "bucket", "classes", "sizes", "counts", "tokens", "scales"])

    return run


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common tokens of a set of n tokens with any partner: ceil(percent * n / 100)."""
    return -((-percent * n) // 100)


def _order(percent: int):
    """One part of the classes: shared tokens rare first; keep classes whose prefix holds a shared token."""

    def run(table: pa.Table) -> pa.Table:
        classes, sizes, owner, row = _blocks_in(table)
        bucket = np.array(table["bucket"].to_pylist(), dtype=np.uint64)
        tokens = np.concatenate([unpack5(x) for x in table["tokens"].to_pylist()]) | (bucket[row] << np.uint64(40))
        scale = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in table["scales"].to_pylist()])
        known, same = np.unique(classes, return_inverse=True)
        size_of = np.zeros(len(known), dtype=np.int64)
        size_of[same] = sizes
        who = same[owner]
        order = np.lexsort((tokens, scale, who))
        tokens, who = tokens[order], who[order]
        first = np.searchsorted(who, np.arange(len(known) + 1))
        shared = np.diff(first)
        prefix = size_of - least_overlap(size_of, percent) + 1 - (size_of - shared)
        rows = [(int(known[i].astype(np.int64)), int(size_of[i]), int(shared[i]), int(min(prefix[i], shared[i])), tokens[first[i] : first[i + 1]].tobytes()) for i in np.flatnonzero(prefix > 0)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["cls", "n", "shared", "prefix", "tokens"])

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of a prefix: its place among the set's shared tokens, and the counts of those by part."""
    for batch in batches:
        got = {k: batch.column(k).to_pylist() for k in ("cls", "n", "shared", "prefix", "tokens")}
        for at in range(0, len(got["cls"]), 500):
            rows = range(at, min(at + 500, len(got["cls"])))
            sets = [np.frombuffer(got["tokens"][i], dtype="<u8") for i in rows]
            k = np.array([got["prefix"][i] for i in rows])
            hist = [np.minimum(np.bincount((mix64(x) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS), FULL).astype(np.uint8).view(np.int64)[0] for x in sets]
            each = np.repeat(np.arange(len(sets)), k)
            own = {c: np.array([got[c][i] for i in rows], dtype=np.int64)[each] for c in ("cls", "n", "shared")}
            place = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
            tokens = np.concatenate([x[:m] for x, m in zip(sets, k, strict=True)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(own["cls"]), pa.array(own["n"]), pa.array(own["shared"]), pa.array(place.astype(np.int64)), pa.array(np.array(hist, dtype=np.int64)[each])], ["token", "cls", "n", "shared", "pos", "hist"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each class's prefix."""
    for batch in batches:
        tokens = [np.frombuffer(t, dtype="<u8")[:k].view(np.int64) for t, k in zip(batch.column("tokens").to_pylist(), batch.column("prefix").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(tokens, pa.list_(pa.int64()))], ["cls", "head"])


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filter on two prefix rows that hold the same token."""
    c = lambda side, name: F.col(f"{side}.{name}")
    need = F.ceil(percent * (c(x, "n") + c(y, "n")) / F.lit(100 + percent) - F.lit(1e-9))
    most = F.least(c(x, "pos"), c(y, "pos")) + F.least(c(x, "shared") - c(x, "pos"), c(y, "shared") - c(y, "pos"))
    byte = lambda side, k: F.shiftrightunsigned(c(side, "hist"), 8 * k).bitwiseAND(F.lit(255))
    least = [F.least(byte(x, k), byte(y, k)) for k in range(PARTS)]
    parts = reduce(lambda s, v: s + v, [F.when(v == FULL, c(x, "n")).otherwise(v) for v in least])
    length = (100 * F.least(c(x, "n"), c(y, "n"))) >= (percent * F.greatest(c(x, "n"), c(y, "n")))
    return length & (most >= need) & (parts >= need)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets link; unshared tokens count in the sizes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype="<u8") for k in ("ta", "tb"))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                union = batch.column("na")[i].as_py() + batch.column("nb")[i].as_py() - common
                keep.append(100 * common >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Staged, so that Spark knows the size of the pairs: later rounds have few, and sets of other classes then stay put.
    pairs = stage(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = sets.join(stage(asked, "asked"), "cls", "left_semi")
    side = lambda k: sets.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def _pairs(rows: DataFrame, percent: int, order: int) -> DataFrame:
    """Pairs of different components for one round, a few for each prefix row, by an order that every round draws anew.

    A row meets the row before it and the first of its list, and ``REPRESENTATIVES`` rows of the component that most of
    the list's rows are in.
    """
    drawn = F.xxhash64("cls", "token", F.lit(order))
    place = Window.partitionBy("token").orderBy(F.floor(F.log(F.col("n").cast("double")) * 4), F.xxhash64("cls", F.lit(order)), "cls")
    row = F.struct("cls", "n", "shared", "pos", "hist", "root")
    met = rows.select("token", row.alias("x"), F.array(F.lag(row).over(place), F.first(row).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("ys"))
    met = met.select("x", F.explode("ys").alias("y"))
    if order:
        sizes = rows.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots"))
        most = sizes.filter("roots > 1 and top.k > 1").select("token", F.col("top.root").alias("main"))
        split = rows.join(most, "token")
        some = split.filter("root = main").withColumn("at", F.row_number().over(Window.partitionBy("token").orderBy(drawn, "cls"))).filter(F.col("at") <= REPRESENTATIVES)
        met = met.unionByName(split.filter("root <> main").select("token", row.alias("x")).join(some.select("token", row.alias("y")), "token").select("x", "y"))
    met = met.filter("y.root <> x.root").filter(_may_link("x", "y", percent))
    return met.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()


def _settle(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after contracting components that a link joins."""
    at = lambda k: labels.select(F.col("cls").alias(k), F.col("root").alias(f"r{k}"))
    found = connected_components(links.join(at("a"), "a").join(at("b"), "b").select("ra", "rb"), "ra", "rb")
    moved = labels.join(found, labels["root"] == found["node"], "left").select("cls", F.coalesce(found["root"], labels["root"]).alias("root"))
    return stage(moved, "labels")


def _components(sets: DataFrame, percent: int) -> DataFrame:
    """(cls, root) of every class that has a partner."""
    rows = sets.mapInArrow(_prefixes, "token long, cls long, n long, shared long, pos long, hist long")
    several = rows.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
    rows = stage(rows.join(several, "token", "left_semi"), "prefixes")
    labels = sets.select("cls", F.col("cls").alias("root"))
    rows = rows.withColumn("root", F.col("cls"))
    classes = sets.count()
    for k in range(MAX_ROUNDS):
        links = stage(_verify(_pairs(rows, percent, k), sets, percent), "links")
        labels = _settle(labels, links)
        # Lists whose classes are all in one component are settled and leave; the others go on with their new labels.
        held = rows.drop("root").join(labels, "cls")
        open_ = held.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
        rows = stage(held.join(open_, "token", "left_semi"), "prefixes")
        per_list = rows.groupBy("token", "root").agg(F.count("*").cast("double").alias("k")).groupBy("token").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("ss"))
        if (per_list.agg(F.sum((F.col("s") * F.col("s") - F.col("ss")) / 2)).first()[0] or 0) <= PAIRS_PER_CLASS * classes or k and links.count() < classes / 100:
            break
    # Of several lists that two classes share, the first pairs them.
    held = rows.join(sets.mapInArrow(_heads, "cls long, head array<long>"), "cls")
    held = stage(held.withColumn("before", F.slice("head", F.lit(1), F.col("pos").cast("int"))).drop("head"), "prefixes")
    x, y = held.alias("x"), held.alias("y")
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y", percent) & ~F.arrays_overlap("x.before", "y.before"))
    links = stage(_verify(rest.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")), sets, percent), "links")
    return _settle(labels, links)


def _labels(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(cls, root) for the classes of a frame with the one column ``text``."""
    parts = shuffle_partitions(texts.sparkSession)
    sent = texts.mapInArrow(_cut(size, parts), "bucket int, " + _BLOCK)
    back = sent.groupBy("bucket").applyInArrow(_count(parts), "part int, bucket int, " + _BLOCK + ", scales binary")
    sets = back.groupBy("part").applyInArrow(_order(percent), "cls long, n long, shared long, prefix long, tokens binary")
    return _components(stage(sets, "sets"), percent)


def similar_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Set size and component of every document: (doc_id, n_shingles, component_id).

    Two documents link when ``100 * |x & y| >= percent * |x | y|`` over their distinct shingles of ``size`` words (words:
    runs without ASCII white space, A-Z lower-cased; a text of fewer words is one shingle). ``component_id`` is the
    smallest id that links reach. A null or blank text has no shingles, links with nothing, not even with another
    blank text, and is its own component. Repeated rows each get a row. A null id counts as no id: it takes the
    smallest id of its component, null where there is none. Extra columns of ``docs`` are never read.
    """
    members = stage(only(docs, doc_id=id_column, text=text_column).mapInArrow(_classes(size), f"doc_id {docs.schema[id_column].dataType.simpleString()}, cls long, n long"), "members")
    labels = _labels(only(docs, text=text_column), size, percent)
    held = members.join(labels, "cls", "left").select("doc_id", "n", F.coalesce("root", "cls").alias("root"))
    full = held.filter("n > 0")
    least = full.groupBy("root").agg(F.min("doc_id").alias("least"))
    done = full.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return done.unionByName(held.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id (null ids last), and one row of it.

    All columns stay as they are. Blank texts link with nothing and all stay, repeated rows of them included.
    """
    cls, n, key, place = free_names(docs, "cls_", "n_", "key_", "place_")
    schema = T.StructType([*docs.schema.fields, T.StructField(cls, T.LongType()), T.StructField(n, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _classes(size)
        for batch in batches:
            (got,) = work(iter([pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(text_column))], ["text"])]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *got.columns], [*batch.schema.names, cls, n])

    texts = only(docs, doc_id=id_column, text=text_column)
    labels = _labels(texts.select("text"), size, percent)
    members = texts.mapInArrow(_classes(size), f"doc_id {docs.schema[id_column].dataType.simpleString()}, cls long, n long").filter("n > 0")
    held = members.join(labels, "cls", "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    one = held.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "cls")).alias("x"))
    one = stage(one.select(F.col("x.cls").alias(cls), F.xxhash64("x.doc_id").alias(key)), "kept")
    has_words = F.coalesce(F.col(q(text_column)).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.filter(has_words).mapInArrow(run, schema).withColumn(key, F.xxhash64(q(id_column)))
    # Of the rows of one id and one set of shingles one stays; the join has dealt them out by the same columns.
    kept = marked.join(one, [cls, key], "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(cls, key).orderBy(F.xxhash64(q(text_column))))).filter(F.col(place) == 1)
    return kept.select(*[q(c) for c in docs.columns]).unionByName(docs.filter(~has_words))
