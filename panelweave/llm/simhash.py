"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits by generalised pigeonhole.

* *Fingerprint*: XXH64 of every shingle of the whole text, repeats included; a bit is one where over half the hashes have it.
  Equal fingerprints are one class; all later work is between classes, so copies are never expanded into pairs.
* *Grouping*: bits that correlate over all fingerprints go to the same part (greedily, from the 64 x 64 moments), which
  leaves the parts as independent of each other as they can be. Fingerprints are permuted so that parts are runs of bits.
* *Thresholds*: two words that differ in at most r bits differ in at most t_i bits within some part i whenever
  sum(t_i) = r - m + 1, t_i >= -1 (-1: the part is not probed). Each class gets its own thresholds: a dynamic programme over
  the parts takes the allocation of the least cost, probes plus candidates as estimated from how often values occur.
* *Probe and verify*: a class asks for every value within t_i bits of its own; an equi-join on (part, value) brings the
  classes that have it, and the join keeps pairs within r bits. A pair is asked for by its smaller word only.

The number of parts follows from the number of classes by the same cost, so candidates grow with the classes, not with their
square; results are the same for every number of parts and all thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import only, stage
from panelweave.llm.components import connected_components

BITS = 64
#: Bytes of a text whose words are held at a time.
CHUNK = 1 << 20
#: Top bits of a part whose values are counted: the counts of all parts fill at most 16 MB at any number of documents.
SEEN_BITS = 16
#: Cost of asking for a value, in candidates checked.
ASK = 2.0
PARTS = (2, 3, 4)
#: Largest threshold of a part; beyond it a part would ask for tens of thousands of values.
MOST = 2
#: A class with more than this share of all rows is joined as a broadcast row: there are fewer than its inverse of them.
HEAVY_SHARE = 1e-3
_SPACES = b" \t\n\r\x0b\x0c"


def _word_runs(low: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text in runs that overlap by ``size - 1`` words, each of about ``CHUNK`` bytes."""
    held: list[bytes] = []
    at, begun = 0, False
    while at < len(low):
        to = min(at + CHUNK, len(low))
        while to < len(low) and low[to] not in _SPACES:
            to += 1
        words = held + low[at:to].split()
        at = to
        if len(words) >= size or at >= len(low) and not begun:
            yield words
            begun, held = True, words[len(words) - size + 1 :]
        else:
            held = words


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text: zero without words; with fewer than ``size``, that of the whole sequence."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for words in _word_runs((text or b"").lower(), size):
        if not words:
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        k = min(size, len(words))
        of = xxhash.xxh64_intdigest
        hashes = np.array([of(flat[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as the signed long of its 64 bits. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            got = np.array([fingerprint(x.as_py(), size, seed) for x in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return only(docs, doc_id=id_column, text=text_column).mapInArrow(run, f"doc_id {docs.schema[id_column].dataType.simpleString()}, fp long")


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _from_bits(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def bit_moments(classes: DataFrame) -> tuple[np.ndarray, int]:
    """How often each two bits are set together, over all classes, and the number of classes: 4,096 sums, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            x = _bits(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.r_[total.ravel(), n])], ["cell", "k"])

    got = classes.select("fp").mapInArrow(run, "cell int, k long").groupBy("cell").agg(F.sum("k").alias("k")).collect()
    sums = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for r in got:
        sums[r["cell"]] = r["k"]
    return sums[:-1].reshape(BITS, BITS), int(sums[-1])


def group_bits(together: np.ndarray, n: int, parts: int) -> list[np.ndarray]:
    """Bits by part, of (nearly) equal sizes: a part starts with the bit that correlates most and takes its nearest ones."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        own = [max(free, key=lambda b: (near[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            nxt = max(free, key=lambda b: (near[b, own].sum(), -b))
            own.append(nxt)
            free.remove(nxt)
        out.append(np.array(own))
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    """All ways to flip exactly ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.uint64)


def allocations(parts: int, distance: int) -> np.ndarray:
    """The thresholds a dynamic programme may end in, for reference: rows t with sum(t) = distance - parts + 1, t >= -1."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(parts):
        out = [(*t, x) for t in out for x in range(-1, distance + 1)]
    return np.array([t for t in out if sum(t) == distance - parts + 1])


class Plan:
    """Parts of the (permuted) word, how often their values occur, and each word's thresholds."""

    def __init__(self, groups: list[np.ndarray], distance: int) -> None:
        self.distance = distance
        self.order = np.concatenate(groups)
        self.widths = [len(g) for g in groups]
        self.shifts = np.r_[0, np.cumsum(self.widths)][:-1]
        self.most = [min(distance, MOST)] * len(groups)
        self.costs: list[np.ndarray] = []

    def permute(self, words: np.ndarray) -> np.ndarray:
        return _from_bits(np.ascontiguousarray(_bits(words)[:, self.order]))

    def restore(self, words: np.ndarray) -> np.ndarray:
        back = np.empty(BITS, dtype=np.int64)
        back[self.order] = np.arange(BITS)
        return _from_bits(np.ascontiguousarray(_bits(words)[:, back]))

    def value(self, words: np.ndarray, part: int) -> np.ndarray:
        return (words >> np.uint64(self.shifts[part])) & np.uint64((1 << self.widths[part]) - 1)

    def seen(self, part: int) -> int:
        return min(SEEN_BITS, self.widths[part])

    def learn(self, counts: list[np.ndarray]) -> None:
        """``costs[part][t + 1, v]``: probes and estimated candidates of a word whose part starts with the bits v."""
        for part, held in enumerate(counts):
            width, seen = self.widths[part], self.seen(part)
            v = np.arange(1 << seen)
            exact = []  # words whose seen bits differ from v in exactly j bits
            for j in range(self.most[part] + 1):
                total = np.zeros(1 << seen)
                for m in _masks(seen, j).astype(np.int64):
                    total += held[v ^ m]
                exact.append(total)
            cost = [np.zeros(1 << seen)]
            for t in range(self.most[part] + 1):
                asked = sum(comb(width, d) for d in range(t + 1))
                found = sum(exact[j] * sum(comb(width - seen, k) for k in range(t - j + 1)) for j in range(t + 1)) / 2.0 ** (width - seen)
                cost.append(ASK * asked + found)
            self.costs.append(np.stack(cost))

    def thresholds(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(threshold by word and part, cost by word): the cheapest allocation by dynamic programming over the parts.

        State: the sum of t + 1 spent so far; it must end at distance + 1.
        """
        budget, n = self.distance + 1, len(words)
        best = np.full((budget + 1, n), np.inf)
        best[0] = 0
        picks = []
        for part, cost in enumerate(self.costs):
            own = cost[:, (self.value(words, part) >> np.uint64(self.widths[part] - self.seen(part))).astype(np.int64)]
            nxt, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
            for spent in range(budget + 1):
                for take in range(min(spent, len(own) - 1) + 1):
                    total = best[spent - take] + own[take]
                    better = total < nxt[spent]
                    nxt[spent][better], pick[spent][better] = total[better], take
            best = nxt
            picks.append(pick)
        state, out = np.full(n, budget), np.zeros((n, len(picks)), dtype=np.int8)
        for part in reversed(range(len(picks))):
            take = picks[part][state, np.arange(n)]
            out[:, part] = take - 1
            state = state - take
        return out, best[budget]

    def key(self, values: np.ndarray, part: int) -> np.ndarray:
        return (values | np.uint64(part << 40)).view(np.int64)

    def index_rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = [self.key(self.value(words, part), part) for part in range(len(self.widths))]
        return np.concatenate(keys), np.tile(words.view(np.int64), len(keys))

    def probe_rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, _ = self.thresholds(words)
        keys, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, width in enumerate(self.widths):
            for radius in range(self.most[part] + 1):
                own = words[t[:, part] >= radius]
                flips = _masks(width, radius)
                keys.append(self.key((self.value(own, part)[:, None] ^ flips[None, :]).ravel(), part))
                who.append(np.repeat(own.view(np.int64), len(flips)))
        return np.concatenate(keys), np.concatenate(who)


def _counts(classes: DataFrame, plan: Plan) -> list[np.ndarray]:
    """How many classes have each value of the seen bits of each part: at most 65,536 sums a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << plan.seen(p), dtype=np.int64) for p in range(len(plan.widths))]
        for batch in batches:
            words = plan.permute(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            for p, held in enumerate(total):
                top = (plan.value(words, p) >> np.uint64(plan.widths[p] - plan.seen(p))).astype(np.int64)
                held += np.bincount(top, minlength=len(held))
        for p, held in enumerate(total):
            v = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), pa.array(v.astype(np.int32)), pa.array(held[v])], ["part", "v", "k"])

    out = [np.zeros(1 << plan.seen(p), dtype=np.int64) for p in range(len(plan.widths))]
    got = classes.select("fp").mapInArrow(run, "part int, v int, k long").groupBy("part", "v").agg(F.sum("k").alias("k")).toArrow()
    part, v, k = (got.column(c).to_numpy() for c in ("part", "v", "k"))
    for p, held in enumerate(out):
        held[v[part == p]] = k[part == p]
    return out


def cheapest_parts(n: int, distance: int, choices: tuple[int, ...] = PARTS) -> int:
    """The number of parts of the least cost for n evenly spread classes: narrow parts ask less and find more."""

    def cost(parts: int) -> float:
        width = BITS // parts
        some = [np.array([0.0, *(sum(comb(width, d) for d in range(t + 1)) * (ASK + n / 2.0**width) for t in range(distance + 1))]) for _ in range(parts)]
        return min(sum(c[t + 1] for c, t in zip(some, row, strict=True)) for row in allocations(parts, distance))

    fit = [m for m in choices if m <= distance + 1 <= (MOST + 1) * m]
    if not fit:
        raise ValueError(f"no number of parts fits {distance} bits")
    return min(fit, key=cost)


def linked_words(classes: DataFrame, distance: int = 3, parts: int | None = None) -> DataFrame:
    """(a, b) of all words ``fp`` of ``classes`` (distinct) that differ in at most ``distance`` bits; a and b differ."""
    together, n = bit_moments(classes)
    plan = Plan(group_bits(together, n, parts or cheapest_parts(n, distance)), distance)
    plan.learn(_counts(classes, plan))
    shared = classes.sparkSession.sparkContext.broadcast(plan)  # counts of at most 2**16 values a part

    def rows(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plan = shared.value
            for batch in batches:
                words = plan.permute(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
                for at in range(0, len(words), 2_000):
                    key, who = getattr(plan, kind)(words[at : at + 2_000])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who)], ["key", "word"])

        return classes.select("fp").mapInArrow(run, "key long, word long")

    x, y = rows("probe_rows").alias("x"), rows("index_rows").alias("y")
    near = F.bit_count(F.col("x.word").bitwiseXOR(F.col("y.word"))) <= distance
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.word") < F.col("y.word")) & near).select(F.col("x.word").alias("a"), F.col("y.word").alias("b")).distinct()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [shared.value.restore(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], ["a", "b"])

    return pairs.mapInArrow(back, "a long, b long")


def _spread_join(rows: DataFrame, table: DataFrame, key: str, value: str, count: str) -> DataFrame:
    """``rows`` with the ``value`` that ``table`` has for their key; ``count`` is how many rows have that key.

    Keys of more than ``HEAVY_SHARE`` of all rows, fewer than its inverse, are broadcast, so their rows stay where they are.
    """
    bound = HEAVY_SHARE * (table.agg(F.sum(count)).first()[0] or 0)
    heavy = table.filter(F.col(count) > max(bound, 1)).select(key, F.struct(value).alias("heavy_"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    light = marked.filter("heavy_ is null").drop("heavy_").join(table.select(key, value), key)
    return marked.filter("heavy_ is not null").withColumn(value, F.col(f"heavy_.{value}")).drop("heavy_").unionByName(light)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, distance: int = 3, parts: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; fingerprints within ``distance`` bits are linked.

    ``component_id`` is the smallest id that links reach. Null, empty and blank texts have fingerprint zero and are linked
    like any other. Repeated rows each get a row. A null id counts as no id: its row takes the smallest id of its
    component, null where there is none. An empty table gives no rows. Extra columns of ``docs`` are never read.
    """
    members = stage(fingerprints(docs, id_column, text_column, size), "fingerprints")
    classes = stage(members.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "words")
    found = connected_components(linked_words(classes, distance, parts))
    held = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    held = stage(held, "held")
    least = stage(held.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("rows")), "least")
    named = stage(_spread_join(held, least, "root", "component_id", "rows").select("fp", "component_id", F.col("copies").alias("rows")), "named")
    rows = _spread_join(members, named, "fp", "component_id", "rows")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
