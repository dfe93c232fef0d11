"""What must not grow with the input: sides that are broadcast, work that one task holds."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelweave.operators.orders import order_search, stack_forecasts
from panelweave.plans.views import SPEC

QUERIES = entry.queries()


def under(plan: str, node: str) -> list[str]:
    """The parts of a printed plan below each such node."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-|")) for x in lines]
    parts = []
    for i, line in enumerate(lines):
        if node in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            parts.append("\n".join(lines[i:end]))
    return parts


@pytest.mark.parametrize("name", ["q_annual_flag", "q_annual_groups", "q_drop_empty_rows", "q_fill_annual", "q_required_after", "q_required_filter", "q_valid_quarters"])
def test_the_customer_grid_is_never_broadcast(spark, name):
    """Spark takes an exploded table for as small as it was before."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan
    assert not [x for x in under(plan, "BroadcastExchange") if "Generate explode" in x]


def test_order_search_fits_every_series_once(spark):
    rows = [(c, t, float((c * 7 + t * t * 3) % 11 + t)) for c in range(5) for t in range(12 + c)]
    df = spark.createDataFrame(rows, "comp long, period long, v double")
    found = order_search(df, SPEC, "v", [(0, 0), (1, 0), (1, 1, 1)], {"val": (9, 10), "test": (10, 11)})
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 6


def test_a_stack_of_series_is_fitted_as_each_alone():
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=(7, 30)), axis=1)
    y[2, 4:6], y[3, 12:], y[4] = np.nan, np.nan, 2.0
    train = np.arange(30) < np.array([25, 20, 25, 10, 25, 1, 7])[:, None]
    now = train.sum(axis=1)
    orders = [(p, d, s) for p in range(3) for d in range(2) for s in range(3)]
    together = stack_forecasts(y, train, now, orders)
    for i in range(7):
        n = int(now[i]) + 1
        alone = stack_forecasts(y[i : i + 1, :n], train[i : i + 1, :n], now[i : i + 1], orders)
        for a, b in zip(alone, together, strict=True):
            np.testing.assert_allclose(a[0], b[i], rtol=1e-7, atol=1e-9)


def test_boosting_passes_read_cells_not_rows(spark):
    """Rows of equal bins are one cell, whatever their number; trials are those of every row on its own."""
    from panelweave.operators.boosting import Boost, Forest, _binned, _cells

    rng = np.random.default_rng(3)
    rows = [(b, "train" if i % 4 else "val", float(i % 3), float(i % 2), float(rng.normal() + i % 3)) for b in ("a", "b") for i in range(600)]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "block string, split string, u double, v double, y double, id long")
    ready, _, base = _binned(df, "block", "split", "y", ["u", "v"], 8)
    forest = Forest([Boost(rows=0.6), Boost()], base, 7, 2, 8, 3)
    cells = _cells(ready.select("__b", "__bins", F.col("y").alias("__y"), "__part", "__h"), forest)
    train = cells.filter("NOT __val").collect()
    assert len(train) == 12 and sum(r["__n"] for r in train) == 900
    assert sum(r["__y"] for r in train) == pytest.approx(sum(r[4] for r in rows if r[1] == "train"))
    assert cells.filter("__val").agg(F.sum("__n")).first()[0] == 300
    for t in range(3):
        assert 0 < sum(r[f"__n0_{t}"] for r in train) < 900


def test_index_permutation_equals_the_fold_of_columns(spark):
    """Batches give the permutation that Spark's own hash draws row by row."""
    from panelweave.operators.models import PERMUTE_ROUNDS, permuted_index

    rows = spark.createDataFrame([(p, n) for n in (1, 2, 97, 5_000_000_000) for p in range(min(n, 97))], "pos long, n long")
    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(3))))
    key, n, pos = [F.lit(7), F.col("again")], F.col("n"), F.col("pos")

    def swap(x, r):
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(PERMUTE_ROUNDS)), pos, swap)
    out = rows.select("n", "again", "pos", permuted_index(pos, n, *key).alias("got"), folded.alias("fold"))
    assert "aggregate(" not in out.drop("fold")._jdf.queryExecution().optimizedPlan().toString()
    found = out.collect()
    assert all(r["got"] == r["fold"] for r in found)
    assert sorted(r["got"] for r in found if r["n"] == 97 and r["again"] == 2) == list(range(97))


def test_fuzzy_match_deals_links_over_all_partitions(spark):
    plan = QUERIES["q_fuzzy_match"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
