"""Plans of the sample path: how many shuffles and joins they hold."""

from __future__ import annotations

import re

import pytest
from conftest import SF

import __spark_entry__ as entry


def shape(df) -> tuple[int, int]:
    """(shuffles, sort-merge joins) of the plan before adaptive execution; with small sides known these only get fewer."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Single|Round)", plan)), plan.count("SortMergeJoin")


@pytest.mark.parametrize(
    "name, shuffles, joins",
    [("q_sample_long", 2, 0), ("q_norm_time", 7, 1), ("q_norm_set", 4, 1), ("q_norm_block", 7, 1), ("q_baseline_avg", 8, 1), ("q_walk_forward", 6, 1), ("q_sample_rejects", 8, 1)],
)
def test_shuffles_of_the_sample_path(spark, name, shuffles, joins):
    got = shape(entry.queries()[name](spark, SF))
    assert got[0] <= shuffles and got[1] <= joins, got
