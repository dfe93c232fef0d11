"""Boosted trees of many blocks and settings at once, by histograms.

Signals are binned once per block, at quantiles of its train rows. Rows of a block with equal bins go the same way in every tree,
so they are added up once into a cell: their number, the sum of y, and both of the rows that each tree draws. Passes read cells,
of which a block has no more than combinations of bins, however many rows. A tree grows level by level: one pass over all cells adds up
residuals and counts by (block, setting, node, signal, bin), the best split of every node follows from these sums alone, and
all trees of all blocks and settings grow in the same pass. A model is a few small arrays, so a pass ships all of them to the
tasks, and rows are never stored again with their predictions. Which rows a block trains on, is judged by and is scored on
follows from the split column; no block sees another's rows.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.windows import small_table
from panelweave.session import staged
from panelweave.spec import q

#: Settings whose sums travel in one row.
CHUNK = 25


@dataclass(frozen=True)
class Boost:
    """One setting. Sums are penalised by ``l1`` and ``l2``; ``rows`` and ``columns`` are the shares each tree sees."""

    depth: int = 3
    step: float = 0.1
    l2: float = 1.0
    l1: float = 0.0
    min_rows: int = 5
    min_gain: float = 0.0
    rows: float = 1.0
    columns: float = 1.0


def boost_settings(grid: Mapping[str, Sequence], trials: int | None = None, seed: int = 7) -> list[Boost]:
    """The grid's settings, or ``trials`` of them in a seeded order."""
    names = sorted(grid)
    space = [Boost(**dict(zip(names, values, strict=True))) for values in product(*[grid[n] for n in names])]
    return random.Random(seed).sample(space, trials) if trials is not None and trials < len(space) else space


def soft(total: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0.0)


def best_split(g: np.ndarray, n: np.ndarray, s: Boost, allowed: np.ndarray) -> tuple[int, int, float, float, int, int]:
    """(signal, bin, left sum, right sum, left rows, right rows) of a node; signal -1: no split, the node's own sum and rows on both sides.

    ``g`` and ``n`` are sums of residuals and rows by signal and bin. Rows up to the bin go left. The first of equal gains wins.
    """
    total, rows = float(g[0].sum()), int(n[0].sum())
    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    right_g, right_n = total - left_g, rows - left_n
    worth = lambda a, k: soft(a, s.l1) ** 2 / np.maximum(k + s.l2, 1e-12)
    gain = worth(left_g, left_n) + worth(right_g, right_n) - worth(np.float64(total), rows)
    gain = np.where((left_n >= s.min_rows) & (right_n >= s.min_rows) & allowed[:, None], gain, -np.inf)
    at = int(np.argmax(gain)) if gain.size else 0
    if not gain.size or not gain.flat[at] > s.min_gain + 1e-12:
        return -1, 0, total, total, rows, rows
    f, b = divmod(at, gain.shape[1])
    return f, b, float(left_g[f, b]), float(right_g[f, b]), int(left_n[f, b]), int(right_n[f, b])


def row_draw(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row hash and tree."""
    x = h.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (tree + 1 + (seed << 20))) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def column_draw(k: int, s: Boost, number: int, tree: int, seed: int) -> np.ndarray:
    """Which signals a tree may split on: at least one."""
    keep = max(1, round(k * s.columns))
    out = np.zeros(k, dtype=bool)
    out[np.random.default_rng([seed, number, tree]).permutation(k)[:keep]] = True
    return out


@dataclass
class Forest:
    """The trees of all blocks and settings as arrays (block, setting, tree, node); nodes in heap order."""

    settings: list[Boost]
    base: np.ndarray
    seed: int
    k: int
    bins: int
    rounds: int
    signal: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    active: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        deepest = max(s.depth for s in self.settings)
        shape = len(self.base), len(self.settings)
        self.signal = np.full((*shape, 0, (1 << deepest) - 1), -1, dtype=np.int16)
        self.at = np.zeros((*shape, 0, (1 << deepest) - 1), dtype=np.int16)
        self.value = np.zeros((*shape, 0, 1 << deepest))
        self.active = np.ones(shape, dtype=bool)

    @property
    def trees(self) -> int:
        return self.signal.shape[2]

    @property
    def shares(self) -> list[float]:
        """The shares of rows below one that settings draw."""
        return sorted({s.rows for s in self.settings if s.rows < 1})

    def plant(self) -> None:
        """A new tree without splits for every block and setting."""
        grow = lambda x, fill: np.concatenate([x, np.full((*x.shape[:2], 1, x.shape[3]), fill, dtype=x.dtype)], axis=2)
        self.signal, self.at, self.value = grow(self.signal, -1), grow(self.at, 0), grow(self.value, 0.0)

    def walk(self, bins: np.ndarray, block: int, setting: int, tree: int, levels: int) -> np.ndarray:
        """The place within its level of the node that each row reaches after some levels; rows of unsplit nodes go left."""
        signal, at = self.signal[block, setting, tree], self.at[block, setting, tree]
        place = np.zeros(bins.shape[1], dtype=np.uint8 if levels < 8 else np.int64)
        for level in range(levels):
            right = np.zeros(bins.shape[1], dtype=bool)
            for node in range(1 << level):
                heap = (1 << level) - 1 + node
                if signal[heap] >= 0:
                    over = bins[signal[heap]] > at[heap]
                    right |= over & (place == node) if level else over
            place = (place << 1) + right
        return place

    def predict(self, bins: np.ndarray, block: int, setting: int, trees: int) -> np.ndarray:
        out = np.full(bins.shape[1], self.base[block])
        depth = self.settings[setting].depth
        for t in range(trees):
            if self.signal[block, setting, t, 0] >= 0:
                out += self.value[block, setting, t][self.walk(bins, block, setting, t, depth)]
        return out


def _batches(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(block, bins by signal, rows) of the runs of one block in every batch."""
    for batch in rows:
        code = batch.column("__b").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(code) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            bins = np.frombuffer(b"".join(part.column("__bins").to_pylist()), dtype=np.uint8).reshape(-1, k).T
            yield int(code[a]), np.ascontiguousarray(bins), part


def _cells(rows: DataFrame, forest: Forest) -> DataFrame:
    """Train rows by (block, bins): their number and sum of y, of all and of those drawn by each share and tree; val rows by (block, bins, y)."""
    k, shares, rounds, seed = forest.k, forest.shares, max(forest.rounds, 1), forest.seed
    sums = ["__n", "__y", *[f"__{c}{i}_{t}" for i in range(len(shares)) for t in range(rounds) for c in "ny"]]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, bins, part in _batches(batches, k):
            split, y, h = (part.column(c).to_numpy(zero_copy_only=False) for c in ("__part", "__y", "__h"))
            train, val = split == 0, split == 1
            text = np.ascontiguousarray(bins.T).view(f"V{k}").ravel()
            seen, place = np.unique(text[train], return_inverse=True)
            ty, th, n = y[train], h[train], len(seen)
            columns = [np.bincount(place, minlength=n).astype(float), np.bincount(place, ty, n)]
            for share in shares:
                for t in range(rounds):
                    drawn = row_draw(th, t, seed) < share
                    columns += [np.bincount(place[drawn], minlength=n).astype(float), np.bincount(place[drawn], ty[drawn], n)]
            columns = [np.r_[c, np.full(val.sum(), float(i == 0))] for i, c in enumerate(columns)]
            keys = [x.tobytes() for x in np.r_[seen, text[val]]]
            own = [pa.array(np.full(len(keys), block, np.int32)), pa.array(keys, pa.binary()), pa.array(np.arange(len(keys)) >= n), pa.array(np.r_[np.zeros(n), y[val]])]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns)], ["__b", "__bins", "__val", "__at", *sums])

    schema = "__b int, __bins binary, __val boolean, __at double, " + ", ".join(f"{c} double" for c in sums)
    parts = rows.filter("__part < 2").mapInArrow(added, schema)
    cells = parts.groupBy("__b", "__bins", "__val", "__at").agg(*[F.sum(c).alias(c) for c in sums])
    cells = cells.withColumn("__y", F.when(F.col("__val"), F.col("__at")).otherwise(F.col("__y"))).drop("__at")
    return staged(cells.repartitionByRange(F.col("__b"), F.col("__bins")).sortWithinPartitions("__b"), "cells")


def _grow(ready: DataFrame, forest: Forest, level: int) -> dict[tuple[int, int], list]:
    """The best splits of all nodes of a level of the newest tree, and the val errors before that tree (level 0)."""
    shared = ready.sparkSession.sparkContext.broadcast(forest)
    k, bins_n, nodes = forest.k, forest.bins, 1 << level
    cells = nodes * k * bins_n

    t, shares = forest.trees - 1, forest.shares

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = shared.value
        held = {}
        for block, bins, part in _batches(batches, k):
            column = lambda c: part.column(c).to_numpy(zero_copy_only=False)
            val = column("__val")
            vb, vy, vn = np.ascontiguousarray(bins[:, val]), column("__y")[val], column("__n")[val]
            # Cells by the share of rows that a tree draws: only those with a row count.
            own = {}
            for i, share in enumerate([1.0, *shares]):
                n, y = (column(c)[~val] for c in (("__n", "__y") if share == 1 else (f"__n{i - 1}", f"__y{i - 1}")))
                own[share] = np.ascontiguousarray(bins[:, ~val][:, n > 0]), y[n > 0], n[n > 0]
            for number, s in enumerate(f.settings):
                if not f.active[block, number] or level >= s.depth:
                    continue
                out = held.setdefault((block, number), np.zeros(2 * cells + 2))
                b, y, n = own[min(s.rows, 1.0)]
                if len(n):
                    r = y - n * f.predict(b, block, number, t)
                    place = f.walk(b, block, number, t, level) * np.int64(k * bins_n)
                    for j in range(k):
                        cell = place + (b[j] + np.int64(j * bins_n))
                        out[:cells] += np.bincount(cell, r, cells)
                        out[cells:-2] += np.bincount(cell, n, cells)
                if level == 0 and len(vy):
                    out[-2:] += (vn * np.abs(vy - f.predict(vb, block, number, t))).sum(), vn.sum()
        rows = [(b, n // CHUNK, n, x.tobytes()) for (b, n), x in held.items()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["b", "chunk", "s", "sums"])

    def choose(table: pa.Table) -> pa.Table:
        f: Forest = shared.value
        total: dict[tuple[int, int], np.ndarray] = {}
        for b, s, x in zip(table["b"].to_pylist(), table["s"].to_pylist(), table["sums"], strict=True):
            x = np.frombuffer(x.as_buffer(), dtype=np.float64)
            total[b, s] = total[b, s] + x if (b, s) in total else x
        rows = []
        for (b, number), x in total.items():
            g, n = x[:cells].reshape(nodes, k, bins_n), x[cells:-2].reshape(nodes, k, bins_n)
            allowed = column_draw(k, f.settings[number], number, f.trees - 1, f.seed)
            splits = [list(map(float, best_split(g[i], n[i], f.settings[number], allowed))) for i in range(nodes)]
            rows.append((b, number, [v for one in splits for v in one], float(x[-2]), float(x[-1])))
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["b", "s", "splits", "loss", "n"])

    drawn = [F.col(f"__{c}{i}_{min(t, max(forest.rounds, 1) - 1)}").alias(f"__{c}{i}") for i in range(len(shares)) for c in "ny"]
    got = ready.select("__b", "__bins", "__val", "__n", "__y", *drawn).mapInArrow(sums, "b int, chunk int, s int, sums binary").groupBy("b", "chunk").applyInArrow(choose, "b int, s int, splits array<double>, loss double, n double")
    out = {(r["b"], r["s"]): [np.array(r["splits"]).reshape(nodes, 6), r["loss"], r["n"]] for r in got.collect()}  # the chosen splits alone
    shared.unpersist()
    return out


def _binned(samples: DataFrame, block: str, split: str, y: str, xs: Sequence[str], bins: int) -> tuple[DataFrame, list, np.ndarray]:
    """(rows with their bins, blocks in order, mean of y on each block's train rows). Bin 0 holds missing values."""
    usable = (q(split) == "train") & q(y).isNotNull()
    shares = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    edges = samples.groupBy(q(block).alias("block_")).agg(
        F.avg(F.when(usable, q(y))).alias("mean_"),
        *[F.array_distinct(F.percentile_approx(F.when(usable, q(x).cast("double")), shares, 10_000)).alias(f"e{i}_") for i, x in enumerate(xs)],
    )
    edges = staged(edges.withColumn("__b", (F.row_number().over(Window.orderBy("block_")) - 1).cast("int")), "edges")
    known = edges.select("block_", "__b", "mean_").orderBy("__b").collect()  # a row for each block
    place = lambda x, e: F.when(q(x).isNull() | F.isnan(q(x).cast("double")), 0).otherwise(1 + F.coalesce(F.size(F.filter(e, lambda v: v < q(x).cast("double"))), F.lit(0)))
    byte = lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))
    part = F.when(q(y).isNull(), 2).when(q(split) == "train", 0).when(q(split) == "val", 1).otherwise(2).cast("int")
    rows = samples.join(edges.withColumnRenamed("block_", block), block).withColumn("__bins", F.concat(*[byte(place(x, F.col(f"e{i}_"))) for i, x in enumerate(xs)]))
    rows = rows.select(*[q(c) for c in samples.columns], "__b", "__bins", part.alias("__part"), F.xxhash64(*[q(c) for c in samples.columns]).alias("__h"))
    rows = staged(rows.repartitionByRange(F.col("__b"), F.col("__h")).sortWithinPartitions("__b"), "binned")
    return rows, [r["block_"] for r in known], np.array([0.0 if r["mean_"] is None else r["mean_"] for r in known])


def boost_blocks(
    samples: DataFrame, block: str, split: str, y: str, xs: Sequence[str], settings: Sequence[Boost], rounds: int = 20, patience: int = 3, bins: int = 32, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """(samples + y_pred, trials): every setting fitted on each block's train rows, the best by mean absolute error on its val rows.

    ``trials``: (block, setting as JSON, trees, val_mae, is_best). A setting keeps as many trees as gave its least val error and
    stops after ``patience`` trees without a lesser one; the first of equal settings is best. A block without a usable val row
    has null errors, its first setting and all rounds. Missing signals have a bin of their own, rows without ``y`` train and judge
    nothing, and every row is scored. A block without train rows predicts 0.
    """
    if not 3 <= bins <= 255:
        raise ValueError("bins must be between 3 and 255")
    ready, blocks, base = _binned(samples, block, split, y, xs, bins)
    forest = Forest(list(settings), base, seed, len(xs), bins, rounds)
    narrow = _cells(ready.select("__b", "__bins", F.coalesce(q(y).cast("double"), F.lit(0.0)).alias("__y"), "__part", "__h"), forest)
    shape = len(blocks), len(settings)
    errors = np.full((*shape, 0), np.nan)
    deepest = max(s.depth for s in settings)
    for tree in range(rounds + 1):
        if not forest.active.any():
            break
        forest.plant()
        for level in range(deepest if tree < rounds else 1):
            got = _grow(narrow, forest, level)
            if level == 0:
                column = np.full((*shape, 1), np.nan)
                for (b, s), (_, loss, n) in got.items():
                    column[b, s] = loss / n if n else np.nan
                errors = np.concatenate([errors, column], axis=2)
                filled = np.where(np.isnan(errors), np.inf, errors)
                stale = tree - filled.argmin(axis=2)
                forest.active &= (stale < patience) | ~np.isfinite(filled).any(axis=2)
                if tree == rounds:
                    break
            for (b, s), (splits, _, _) in got.items():
                if not forest.active[b, s]:
                    continue
                first = (1 << level) - 1
                forest.signal[b, s, tree, first : first + len(splits)] = splits[:, 0]
                forest.at[b, s, tree, first : first + len(splits)] = splits[:, 1]
                own = forest.settings[s]
                if level == own.depth - 1:
                    leaf = own.step * soft(splits[:, 2:4], own.l1) / np.maximum(splits[:, 4:6] + own.l2, 1e-12)
                    forest.value[b, s, tree, : leaf.size] = leaf.ravel()
    known = ~np.isnan(errors).all(axis=2)
    filled = np.where(np.isnan(errors), np.inf, errors)
    trees = np.where(known, filled.argmin(axis=2), min(rounds, forest.trees))
    least = filled.min(axis=2)
    best = least.argmin(axis=1)
    names = [json.dumps(asdict(s), sort_keys=True) for s in settings]
    at = [(i, j) for i in range(shape[0]) for j in range(shape[1])]
    schema = pa.schema([("b", pa.int32()), ("setting", pa.string()), ("trees", pa.int64()), ("val_mae", pa.float64()), ("is_best", pa.bool_())])
    columns = {"b": [i for i, _ in at], "setting": [names[j] for _, j in at], "trees": [int(trees[i, j]) for i, j in at], "val_mae": [float(least[i, j]) if known[i, j] else None for i, j in at], "is_best": [j == best[i] for i, j in at]}
    codes = ready.select(q(block), F.col("__b").alias("b")).distinct()
    trials = small_table(ready.sparkSession, columns, schema).join(codes, "b").select(block, "setting", "trees", "val_mae", "is_best")
    return _scored(ready, forest, best, trees, samples.columns), trials


def _scored(ready: DataFrame, forest: Forest, best: np.ndarray, trees: np.ndarray, columns: Sequence[str]) -> DataFrame:
    """The samples with the prediction of their block's best setting."""
    shared = ready.sparkSession.sparkContext.broadcast((forest, best, trees))
    kept = [f for f in ready.schema if f.name in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, chosen, n = shared.value
        for block, bins, part in _batches(batches, f.k):
            s = int(chosen[block])
            got = f.predict(bins, block, s, int(n[block, s]))
            yield pa.RecordBatch.from_arrays([*[part.column(c.name) for c in kept], pa.array(got)], [*[c.name for c in kept], "y_pred"])

    return ready.select(*[q(f.name) for f in kept], "__b", "__bins").mapInArrow(run, T.StructType([*kept, T.StructField("y_pred", T.DoubleType())]))
