"""URL rules by a Bloom filter cascade: exact membership for every key that the corpus can ask about, without joins.

A rule is a host and a path prefix. A url asks for one key for each of its host's suffixes and each path length that
rules have. The cascade's levels alternate: level 0 holds the listed keys, level 1 those keys of the corpus that pass
level 0 without being listed, level 2 the listed keys that pass level 1, and so on until nothing passes. Since the
false positives are taken from the *complete* universe of the corpus's keys, a walk down the levels answers exactly.

Level 0 is sized so that the false positives of the universe are about as many as the listed keys; further levels halve.
All levels together so follow the list, not the corpus. They are broadcast while they are below ``FILTER_BYTES``;
a longer list is split by hash into as many cascades as needed, and the urls pass them one after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import only, stage

#: Bytes of one cascade that may be broadcast.
FILTER_BYTES = 64_000_000
#: Listed keys per cascade, so that 48 bits a key stay below that.
KEYS_PER_CASCADE = 8_000_000


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class Level:
    """A Bloom filter: ``bits`` bits and ``k`` places for each key, from the two halves of its hash."""

    def __init__(self, n: int, rate: float) -> None:
        self.k = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(n * self.k / math.log(2)))
        self.words = np.zeros(-(-self.bits // 8), dtype=np.uint8)

    def places(self, h1: np.ndarray, h2: np.ndarray, depth: int) -> np.ndarray:
        """(key, place): bit numbers. Levels differ by depth, else a key would fall alike in all of them."""
        with np.errstate(over="ignore"):
            a = h1.view(np.uint64) ^ np.uint64((depth + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            a = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            a ^= a >> np.uint64(29)
            b = h2.view(np.uint64) * np.uint64(2 * depth + 1) | np.uint64(1)
            x = a[:, None] + np.arange(self.k, dtype=np.uint64)[None, :] * b[:, None]
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            return (x ^ (x >> np.uint64(33))) % np.uint64(self.bits)

    def add(self, h1: np.ndarray, h2: np.ndarray, depth: int) -> None:
        at = self.places(h1, h2, depth).ravel()
        np.bitwise_or.at(self.words, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def passes(self, h1: np.ndarray, h2: np.ndarray, depth: int) -> np.ndarray:
        at = self.places(h1, h2, depth)
        return ((self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def _held(keys: DataFrame, level: Level, depth: int) -> Level:
    """``level`` with all keys added: each task sets its bits, bytes are merged by OR before they reach the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Level.__new__(Level)
        own.k, own.bits, own.words = level.k, level.bits, np.zeros(len(level.words), dtype=np.uint8)
        for batch in batches:
            own.add(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), depth)
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.words[at].astype(np.int32))], ["at", "b"])

    got = keys.select("h1", "h2").mapInArrow(bits, "at long, b int").groupBy("at").agg(F.bit_or("b").alias("b")).toPandas()
    level.words[got["at"].to_numpy(int)] = got["b"].to_numpy(np.uint8)
    return level


def in_cascade(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership: the first level that a key does not pass decides by its parity."""
    inside = np.zeros(len(h1), dtype=bool)
    open_ = np.arange(len(h1))
    for depth, level in enumerate(levels):
        go = level.passes(h1[open_], h2[open_], depth)
        inside[open_[~go]] = depth % 2 == 1
        open_ = open_[go]
    inside[open_] = len(levels) % 2 == 1
    return inside


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for the keys ``listed`` (h1, h2) that answer every key of ``universe`` (h1, h2) exactly.

    An empty list has no levels, and nothing is in it. The universe is scanned once, for level 0; all later levels work
    on false positives, which are about as many as listed keys. Repeated keys and nulls in the universe are harmless.
    """
    inside = stage(listed.select("h1", "h2").filter("h1 is not null").distinct(), "cascade-keys")
    r = inside.count()
    if not r:
        return []
    s = universe.agg(F.approx_count_distinct("h1")).first()[0]
    levels: list[Level] = []
    outside: DataFrame | None = None
    while True:
        depth = len(levels)
        first = depth == 0
        members, others = (inside, outside) if depth % 2 == 0 else (outside, inside)
        n = members.count()
        if not n:
            return levels
        rate = min(0.5, r / (max(s, 1) * math.sqrt(2))) if first else 0.5
        levels.append(_held(members, Level(n, rate), depth))
        level = levels[-1]

        def passed(batches: Iterator[pa.RecordBatch], level: Level = level, depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(level.passes(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), depth)))

        source = universe.select("h1", "h2").filter("h1 is not null and h2 is not null") if first else others
        through = source.mapInArrow(passed, "h1 long, h2 long")
        if first:
            through = through.distinct().join(inside, ["h1", "h2"], "left_anti")
        through = stage(through, "cascade-keys")
        if depth % 2 == 0:
            outside = through
        else:
            inside = through


def _candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every key that a url asks for: (length of the host suffix, key)."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring(path, 1, n).alias("p")) for n in lengths]), lambda x: F.length(x["p"]) == x["n"])
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p["p"]))))
    return F.array_distinct(pairs)


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` has (host, path, verdict), verdict ``allow`` or ``block``; a rule's key is its host and path together. A rule
    fits its host and all subdomains when the url's path starts with the rule's; the longest key wins, block before
    allow if a key is in both lists. A url that no rule fits has a null ``rule`` and ``default``: it is in no list. A null url
    or one without ``://`` has empty host and path, and only rules of an empty host fit it. Rules with a null host are no
    rules, a null path is empty; host letters A-Z are lower-cased. Repeated rules count once, repeated pages each get a row.
    """
    spark = pages.sparkSession
    known = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host is not null")
    known = known.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict").distinct()
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())
    rows = only(pages, page_id=id_column, url=url_column)
    rows = rows.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    asked = rows.withColumn("keys", _candidates(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    universe = asked.select(F.explode("keys").alias("key")).select(*_hashes(F.col("key")))
    listed = {v: known.filter(F.col("verdict") == v).select(*_hashes(F.col("key"))) for v in ("block", "allow")}
    names = asked.columns
    out = T.StructType([*asked.schema.fields, T.StructField("rule", T.StringType()), T.StructField("found", T.StringType())])
    done = asked.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("found"))
    for verdict, keys in listed.items():
        parts = max(1, -(-keys.count() // KEYS_PER_CASCADE))
        for part in range(parts):
            own = (lambda df: df.filter(F.pmod("h2", F.lit(parts)) == part)) if parts > 1 else (lambda df: df)  # noqa: B023
            levels = build_cascade(own(keys), own(universe))
            if not levels:
                continue
            held = spark.sparkContext.broadcast(levels)

            def probe(batches: Iterator[pa.RecordBatch], held=held, verdict=verdict, parts=parts, part=part) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    table = {n: batch.column(n) for n in batch.schema.names}
                    owner = np.repeat(np.arange(batch.num_rows), np.diff(table["keys"].offsets.to_numpy()))
                    keys = table["keys"].flatten()
                    h1, h2 = table["h1"].flatten().to_numpy(), table["h2"].flatten().to_numpy()
                    inside = in_cascade(held.value, h1, h2)
                    if parts > 1:
                        inside &= h2 % parts == part
                    rule, found = table["rule"].to_pylist(), table["found"].to_pylist()
                    for i in np.flatnonzero(inside):
                        key, k = keys[int(i)].as_py(), int(owner[i])
                        if rule[k] is None or len(key) > len(rule[k]):
                            rule[k], found[k] = key, verdict
                    yield pa.RecordBatch.from_arrays([*[table[x] for x in names], pa.array(rule, pa.string()), pa.array(found, pa.string())], out.names)

            hashed = done.select("*", F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"), F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)).alias("h2"))
            done = hashed.mapInArrow(probe, out)
    return done.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
