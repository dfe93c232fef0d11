"""Histogram boosting against one block's trees grown by plain loops."""

from __future__ import annotations

import json

import numpy as np
import pytest

from panelweave.operators.boosting import Boost, best_split, boost_blocks, boost_settings, column_draw


def plain_trees(rows: list[tuple], s: Boost, rounds: int, bins: int) -> tuple[list[float], list[list[float]]]:
    """(val error by number of trees, predictions by number of trees) of rows (split, y, signals), tree by tree."""
    k = len(rows[0][2])
    edges = []
    for j in range(k):
        x = sorted(r[2][j] for r in rows if r[0] == "train" and r[1] is not None and r[2][j] is not None)
        edges.append(sorted({x[max(int(np.ceil(len(x) * i / (bins - 1))) - 1, 0)] for i in range(1, bins - 1)}))
    binned = [[0 if v is None else 1 + sum(e < v for e in edges[j]) for j, v in enumerate(r[2])] for r in rows]
    train = [i for i, r in enumerate(rows) if r[0] == "train" and r[1] is not None]
    val = [i for i, r in enumerate(rows) if r[0] == "val" and r[1] is not None]
    guess = [sum(rows[i][1] for i in train) / len(train)] * len(rows)
    errors, states = [], []
    soft = lambda g: np.sign(g) * max(abs(g) - s.l1, 0.0)
    worth = lambda g, n: soft(g) ** 2 / (n + s.l2)
    for _ in range(rounds + 1):
        errors.append(sum(abs(rows[i][1] - guess[i]) for i in val) / len(val))
        states.append(list(guess))
        nodes = [(train, list(range(len(rows))))]
        split_root = False
        for level in range(s.depth):
            nxt = []
            for own, all_ in nodes:
                g = sum(rows[i][1] - guess[i] for i in own)
                best = (s.min_gain + 1e-12, None)
                for j in range(k):
                    for b in range(bins - 1):
                        left = [i for i in own if binned[i][j] <= b]
                        if min(len(left), len(own) - len(left)) < s.min_rows:
                            continue
                        gl = sum(rows[i][1] - guess[i] for i in left)
                        gain = worth(gl, len(left)) + worth(g - gl, len(own) - len(left)) - worth(g, len(own))
                        if gain > best[0] + 1e-9:
                            best = (gain, (j, b))
                if best[1] is None:
                    nxt += [(own, all_), ([], [])]
                    continue
                split_root |= level == 0
                j, b = best[1]
                nxt += [([i for i in part if binned[i][j] <= b], [i for i in every if binned[i][j] <= b]) if low else ([i for i in part if binned[i][j] > b], [i for i in every if binned[i][j] > b]) for low in (True, False) for part, every in [(own, all_)]]
            nodes = nxt
        if split_root:
            steps = [(s.step * soft(sum(rows[i][1] - guess[i] for i in own)) / (len(own) + s.l2) if own else 0.0, all_) for own, all_ in nodes]
            for step, all_ in steps:
                for i in all_:
                    guess[i] += step
    return errors, states


def some_rows(seed: int, n: int = 90) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = [None if rng.random() < 0.1 else float(rng.integers(0, 9)), float(np.round(rng.normal(), 2)), 1.0]
        y = None if i % 30 == 7 else float(np.round((x[0] or 0) * 0.5 + (x[1] > 0) * 2 + rng.normal() / 4, 3))
        rows.append((("train", "train", "val", "test")[i % 4], y, x))
    return rows


@pytest.mark.parametrize("s", [Boost(depth=2, step=0.5, min_rows=3), Boost(depth=3, step=0.3, l2=0.5, l1=0.2, min_rows=4, min_gain=0.05), Boost(depth=1, step=1.0, l2=0.0, min_rows=1)])
def test_trees_equal_plain_loops(spark, s):
    rounds, bins = 4, 8
    blocks = {"b1": some_rows(1), "b2": some_rows(2, 61)}
    flat = [(b, r[0], i, r[1], *r[2]) for b, rows in blocks.items() for i, r in enumerate(rows)]
    df = spark.createDataFrame(flat, "block string, split string, id int, y double, a double, b double, c double").repartition(3)
    scored, trials = boost_blocks(df, "block", "split", "y", ["a", "b", "c"], [s], rounds=rounds, patience=99, bins=bins)
    tried = {r["block"]: r for r in trials.collect()}
    got = {(r["block"], r["id"]): r["y_pred"] for r in scored.collect()}
    assert len(got) == len(flat)
    for b, rows in blocks.items():
        errors, states = plain_trees(rows, s, rounds, bins)
        assert tried[b]["val_mae"] == pytest.approx(min(errors)) and tried[b]["is_best"]
        assert errors[tried[b]["trees"]] == pytest.approx(min(errors))
        assert [got[b, i] for i in range(len(rows))] == pytest.approx(states[tried[b]["trees"]])
        assert json.loads(tried[b]["setting"])["depth"] == s.depth


def test_many_settings_blocks_without_val_and_missing_values(spark):
    rows = [("b1", *r[:2], *r[2]) for r in some_rows(3)] + [("b2", "train" if i % 3 else "test", float(i), float(i), None, None) for i in range(30)] + [("b3", "test", 1.0, 1.0, 1.0, 1.0), ("b3", "val", None, None, None, None)]
    df = spark.createDataFrame(rows, "block string, split string, y double, a double, b double, c double")
    settings = boost_settings({"depth": [1, 2], "step": [0.1, 0.5], "rows": [0.5, 1.0], "columns": [0.4, 1.0], "min_rows": [2]})
    scored, trials = boost_blocks(df, "block", "split", "y", ["a", "b", "c"], settings, rounds=3, patience=1)
    tried = trials.collect()
    assert len(tried) == 3 * 16 and sum(r["is_best"] for r in tried) == 3
    assert {r["block"] for r in tried if r["val_mae"] is None} == {"b2", "b3"}
    best = min((r for r in tried if r["block"] == "b1"), key=lambda r: r["val_mae"])
    assert best["val_mae"] == next(r["val_mae"] for r in tried if r["block"] == "b1" and r["is_best"])
    out = scored.collect()
    assert len(out) == len(rows) and all(r["y_pred"] is not None for r in out)
    again = boost_blocks(df, "block", "split", "y", ["a", "b", "c"], settings, rounds=3, patience=1)[1].collect()
    assert sorted(map(str, again)) == sorted(map(str, tried))


def test_settings_and_splits():
    grid = {"depth": [1, 2, 3], "step": [0.1, 0.2], "l2": [0.0, 1.0]}
    assert len(boost_settings(grid)) == 12 and len(boost_settings(grid, 5)) == 5 and boost_settings(grid, 5) == boost_settings(grid, 5)
    assert column_draw(4, Boost(columns=0.5), 0, 0, 1).sum() == 2 and column_draw(4, Boost(columns=0.0), 0, 0, 1).sum() == 1
    g, n = np.array([[4.0, -4.0, 0.0]]), np.array([[2, 2, 0]])
    assert best_split(g, n, Boost(min_rows=1, l2=0.0), np.array([True])) == (0, 0, 4.0, -4.0, 2, 2)
    assert best_split(g, n, Boost(min_rows=3), np.array([True]))[0] == -1
    assert best_split(g, n, Boost(min_rows=1), np.array([False]))[0] == -1
