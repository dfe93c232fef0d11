"""Nearest neighbours by inner product: multi-index hashing of learned rotated binary codes, reranked on floats.

Vectors become points on a sphere (one more component evens out their lengths; queries get none of it), so the largest
inner product is the smallest angle. ``ROTATIONS`` rotations are learned by iterative quantisation on a bounded sample
(``SAMPLE_ROWS`` vectors); the signs of the rotated components are the code. A code is cut into 8-bit substrings, each
with an index of its own: for every value of the substring the rows within a small Hamming distance, as a bitmap. By the
pigeonhole principle a code within radius r of the query has a substring within r divided by the number of substrings,
so joining the bitmaps of the query's substrings gives every code within the radius; those are checked on whole codes
and reranked by the exact inner product of the original vectors.

The radius is learned from the sample too: the distance below which ``SHARE`` of true neighbours lie. Where fewer than
k codes are inside, it grows substring by substring until k are found or every code is.

Rows are indexed in shards of about ``SHARD_ROWS``, queries come in blocks; each pair of shard and block is one task of
bounded size and returns at most k rows per query. Equal vectors within a shard are indexed once: of their ids only
the k + 1 smallest can be among the nearest. On vectors without structure the radius is large and the substrings
prune little: the whole-code check then does the work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import only

SAMPLE_ROWS = 4096
ROTATIONS = 4
SHARE = 0.98
SHARD_ROWS = 8192
BLOCK_QUERIES = 16384
REPEATS = 10_000

_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_NEAR = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


@dataclass
class Codes:
    """Rotations learned, the largest length (for the evening component), and the radius."""

    rotations: np.ndarray
    longest: float
    radius: int

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1) / self.longest**2))
        return self._bits(np.c_[x / self.longest, rest])

    def queries(self, x: np.ndarray) -> np.ndarray:
        return self._bits(np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])

    def _bits(self, x: np.ndarray) -> np.ndarray:
        """A byte for each substring."""
        bits = x @ self.rotations >= 0
        pad = -bits.shape[1] % 8
        return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of code ``a`` to each of ``b``."""
    return _POP[a[None, :] ^ b].sum(1, dtype=np.int64)


def learn_codes(sample: np.ndarray, longest: float, k: int, seed: int = 1) -> Codes:
    """Rotations by iterative quantisation: alternate between signs and the rotation that fits them best."""
    random = np.random.default_rng(seed)
    unit = np.c_[sample / longest, np.sqrt(np.maximum(0.0, 1 - (sample * sample).sum(1) / longest**2))]
    d = unit.shape[1]
    parts = []
    for _ in range(ROTATIONS):
        r, _ = np.linalg.qr(random.normal(size=(d, d)))
        for _ in range(20):
            signs = np.where(unit @ r >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(unit.T @ signs)
            r = u @ v
        parts.append(r)
    codes = Codes(np.concatenate(parts, axis=1), longest, 0)
    probes = sample[:256]
    own = codes.rows(sample)
    asked = codes.queries(probes)
    inner = probes @ sample.T
    near = []
    for i in range(len(probes)):
        inner[i, i] = -np.inf
        best = np.argpartition(-inner[i], min(k, len(sample) - 1))[:k]
        near.append(_distances(asked[i], own[best]))
    codes.radius = int(np.quantile(np.concatenate(near), SHARE)) if near and len(sample) > 1 else own.shape[1] * 8
    return codes


class ShardIndex:
    """Multi-index of one shard: a bitmap of rows for every substring, value and distance asked for."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.parts = codes.shape[1]
        self.exact = np.zeros((self.parts, 256, -(-len(codes) // 8)), dtype=np.uint8)
        for j in range(self.parts):
            flags = codes[:, j][None, :] == np.arange(256, dtype=np.uint8)[:, None]
            self.exact[j] = np.packbits(flags, axis=1)
        self.near: dict[int, np.ndarray] = {}

    def within(self, distance: int) -> np.ndarray:
        """(substring, value, bitmap) of the rows whose substring is at most ``distance`` from the value."""
        if distance not in self.near:
            out = np.zeros_like(self.exact)
            close = _NEAR <= distance
            for j in range(self.parts):
                used = np.flatnonzero(self.exact[j].any(1))
                for value in range(256):
                    out[j, value] = np.bitwise_or.reduce(self.exact[j, used[close[value, used]]], axis=0)
            self.near = {distance: out}
        return self.near[distance]

    def search(self, code: np.ndarray, radius: int, k: int) -> np.ndarray:
        """Rows within ``radius``, or within the smallest larger one (in steps of a bit per substring) that has k."""
        while True:
            # radius = parts * a + b: one of the first b + 1 substrings is within a, or another within a - 1.
            a, b = divmod(radius, self.parts)
            if a >= 8:
                return np.arange(len(self.codes))
            map_ = np.bitwise_or.reduce(self.within(a)[np.arange(self.parts), code], axis=0)
            rows = np.flatnonzero(np.unpackbits(map_, count=len(self.codes)))
            rows = rows[_distances(code, self.codes[rows]) <= radius]
            if len(rows) >= min(k, len(self.codes)):
                return rows
            radius += self.parts // 2


def _search(held, k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "mark", "times", "vec_id", "score"]
        kinds = [*[queries.schema.field(c).type for c in ("id", "mark", "times")], rows.schema.field("id").type, pa.float64()]
        if not rows.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        matrix = lambda t: np.array(t["v"].combine_chunks().flatten().to_numpy(), dtype=np.float64).reshape(t.num_rows, -1)
        x, ids = matrix(rows), rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        distinct, which = np.unique(x, axis=0, return_inverse=True)
        members = np.argsort(which, kind="stable")
        first = np.searchsorted(which[members], np.arange(len(distinct) + 1))
        codes: Codes = held.value
        index = ShardIndex(codes.rows(distinct))
        asked, qids = matrix(queries), queries["id"].to_numpy()
        places, out = [], [[], []]
        signs = codes.queries(asked)
        for place, (q, query, code) in enumerate(zip(qids, asked, signs, strict=True)):
            found = index.search(code, codes.radius, k + 1)
            score = np.einsum("ij,j->i", distinct[found], query)
            best = np.argsort(-score, kind="stable")
            if len(best) > k + 1:
                best = best[score[best] >= score[best[k]]]
            own = [(-score[b], i) for b in best for i in ids[members[first[found[b]] : first[found[b] + 1]][: k + 1]] if i != q]
            own = sorted(own)[:k]
            places.append(np.full(len(own), place))
            out[0].append(np.array([i for _, i in own], dtype=ids.dtype))
            out[1].append(np.array([-s for s, _ in own], dtype=np.float64))
        own = queries.select(["id", "mark", "times"]).take(pa.array(np.concatenate(places), pa.int64()))
        return pa.Table.from_arrays([*own.columns, *[pa.array(np.concatenate(x), t) for x, t in zip(out, kinds[3:], strict=True)]], names=names)

    return run


def nearest_vectors(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``: (query_id, rank, vec_id, score).

    Nearest is the largest inner product in double precision, ties go to the smaller id; a query never finds its own id.
    Vectors that are null, zero or of no component, or hold a null or non-finite component take no part, neither do
    rows of null id and vectors whose length differs from the most frequent one (of two, the smaller). Rows of one
    id and different vectors are different candidates and different queries. A query row that is there several times is
    searched once and has its ranks that many times. With no vectors or no queries the result is empty.
    """
    spark = vectors.sparkSession
    rows = only(vectors, id=id_column, v=vector_column).select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter("id is not null and v is not null").filter(F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest"), F.sum((F.col("id") % every == 0).cast("long")).alias("asked"))
    top = sizes.orderBy(F.desc("n"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if top is None or not top["asked"]:
        return empty
    rows = rows.filter(F.size("v") == top["d"])
    n, asked = int(top["n"]), int(top["asked"])
    # A bounded sample by a hash of the id.
    share = min(1.0, SAMPLE_ROWS / n)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * SAMPLE_ROWS).toPandas().sort_values("id")
    points = np.stack(sample["v"].to_numpy()) if len(sample) else np.eye(top["d"])
    held = spark.sparkContext.broadcast(learn_codes(points, float(top["longest"]), k))
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // BLOCK_QUERIES))
    number = lambda parts: F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")
    every_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    side = rows.select("id", "v", number(shards).alias("shard"), every_of(blocks).alias("block"))
    # The mark tells apart queries of one id.
    mark = F.unhex(F.md5(F.array_join(F.col("v").cast("array<string>"), ",")))
    asks = rows.filter(F.col("id") % every == 0).groupBy("id", "v").agg(F.count("*").alias("times"))
    asks = asks.select("id", "v", mark.alias("mark"), "times", number(blocks).alias("block"), every_of(shards).alias("shard"))
    found = side.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(_search(held, k), "query_id long, mark binary, times long, vec_id long, score double")
    place = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    # In runs of up to REPEATS, so that no array grows with the copies of one row.
    runs = best.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))).alias("run"))
    copies = F.least(F.lit(REPEATS).cast("long"), F.col("times") - F.col("run") * REPEATS)
    return runs.select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("copy_")).drop("copy_")
