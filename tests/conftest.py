from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelweave.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


def series(spark, *values, comp=1, start=1):
    """One entity's measure ``v`` over periods start, start + 1, ..."""
    rows = [(comp, start + i, "g", None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "comp long, period long, industry string, v double")


def column(df, name, order=("comp", "period")):
    return [r[name] for r in df.orderBy(*order).collect()]
