"""Samples stored and read back, examples by number, last values looked up across ranges."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import functions as F

from panelweave.operators.groups import asof_lookup
from panelweave.plans.prepare import SamplePlan, Samples
from panelweave.sources import tables as tb
from panelweave.spec import PanelSpec

SPEC = PanelSpec()


def samples(spark) -> Samples:
    rows = [(c, t, "g", float(c * 10 + t), float(t % 3)) for c in range(6) for t in range(9)]
    panel = spark.createDataFrame(rows, "comp long, period long, industry string, a double, b double")
    return SamplePlan(panel, SPEC, ["a", "b"], ["a"]).window(2, 1).block_rolling_split(3).normalize("time").compute()


def test_store_and_load(spark):
    made = samples(spark)
    made.store("kept_samples", buckets=3)
    read = Samples.load(spark, "kept_samples")
    by = ["block", "split", "comp", "start"]
    assert read.samples.select(*made.samples.columns).orderBy(*by).collect() == made.samples.orderBy(*by).collect()
    assert (read.features, read.targets, read.spec, read.settings) == (made.features, made.targets, made.spec, made.settings)
    assert read.blocks() == made.blocks() and read.norm.count() == made.norm.count() and read.rejects.count() == made.rejects.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_entity = read.samples.groupBy("comp").count()
        joined = read.samples.select("comp", "start").join(per_entity, "comp")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and joined.count() == made.samples.count()
    block = read.block(read.blocks()[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in block
    for name in ("", "_windows", "_norm", "_rejects", "_card"):
        spark.sql(f"DROP TABLE kept_samples{name}")


def test_examples_by_number(spark):
    made = samples(spark)
    n = made.samples.count()
    got = made.example([0, 3, n - 1, n + 5]).collect()
    assert sorted(r["number"] for r in got) == [0, 3, n - 1]
    norm = {(r["start"], r["feature"]): (r["mean"], r["std"]) for r in made.norm.collect()}
    for r in got:
        assert {f["feature"]: (f["mean"], f["std"]) for f in r["norm"]} == {c: norm[r["start"], c] for c in ("a", "b")}
    assert sorted(made.example(range(n)).select("block", "split", "comp", "start").collect()) == sorted(made.samples.select("block", "split", "comp", "start").collect())


def test_write_and_export(spark, tmp_path):
    made = samples(spark)
    made.write(f"{tmp_path}/samples")
    assert spark.read.parquet(f"{tmp_path}/samples").filter("split = 'val'").count() == made.samples.filter("split = 'val'").count()
    flat = made.last_step()
    tb.export_splits(flat, f"{tmp_path}/csv")
    tb.write_side_file(spark, f"{tmp_path}/card", made.card())
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == flat.count()
    assert tb.read_side_file(spark, f"{tmp_path}/card")["columns"]["x"] == {"0": "a", "1": "b"}
    tb.export_csv(flat.drop("split"), f"{tmp_path}/one")
    assert spark.read.option("header", True).csv(f"{tmp_path}/one").count() == flat.count()


def test_export_with_properties_alongside(spark, tmp_path):
    made = samples(spark)
    made.export(f"{tmp_path}/export")
    read = Samples.read_export(spark, f"{tmp_path}/export")
    for name, df in (("steps", made.long()), ("samples", made.truths()), ("norm", made.norm)):
        by = [c for c in df.columns if c not in ("a", "b", "mean", "std", "target_a")]
        assert read[name].schema.names and dict(read[name].dtypes) == dict(df.dtypes)
        assert read[name].select(*df.columns).orderBy(*by).collect() == df.orderBy(*by).collect()
    assert {p.name for p in (tmp_path / "export" / "steps").iterdir() if p.is_dir()} == {"split=test", "split=train", "split=val"}
    assert tb.read_side_file(spark, f"{tmp_path}/export/card")["columns"]["y"] == {"0": "a"}
    # Several predicted steps have a row each.
    rows = [(c, t, "g", float(c * 10 + t)) for c in range(2) for t in range(9)]
    panel = spark.createDataFrame(rows, "comp long, period long, industry string, a double")
    two = SamplePlan(panel, SPEC, ["a"], ["a"]).window(2, 2).block_rolling_split(2).compute()
    got = {(r["comp"], r["start"], r["target_step"], r["target_a"]) for r in two.truths().collect()}
    assert got == {(c, s, k, float(c * 10 + s + 2 + k)) for c, s, k, _ in got} and {k for _, _, k, _ in got} == {0, 1}


def test_lookup_across_ranges_and_groups(spark):
    rng = np.random.default_rng(6)
    left = [("ab"[int(g)], int(k)) for g, k in zip(rng.integers(0, 2, 800), rng.integers(0, 5000, 800), strict=True)] + [("c", 7), (None, 3), ("a", None)]
    right = [("ab"[i % 2], int(k), float(i)) for i, k in enumerate(rng.choice(5000, 60, replace=False))] + [("a", 4999, None), ("d", 1, 1.0)]
    l, r = spark.createDataFrame(left, "g string, k long"), spark.createDataFrame(right, "g string, k long, v double")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = asof_lookup(l, r, "k", ["v"], ["g"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = {(x["g"], x["k"]): x["v"] for x in got.collect()}
        whole = {x["k"]: x["v"] for x in asof_lookup(l, r, "k", ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "SinglePartition" not in plan
    for g in "abc":
        own = sorted((k, v) for h, k, v in right if h == g)
        for k in {k for h, k in left if h == g and k is not None}:
            at = bisect_right([x for x, _ in own], k) - 1
            assert rows[g, k] == (own[at][1] if at >= 0 else None)
    every = sorted((k, v) for _, k, v in right)
    for k in {k for _, k in left if k is not None}:
        at = bisect_right([x for x, _ in every], k) - 1
        assert whole[k] == (every[at][1] if at >= 0 else None)
