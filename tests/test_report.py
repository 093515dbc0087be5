"""Reports on histories with residuals of zero."""

from __future__ import annotations

import pytest

from tests.oracle import connect, same
from tidalframe.plans import registry

VALUES = {1: [4.0, 2.0, 1.0], 2: [4.0, 0.0, 2.0, 1.0], 3: [2.0, 0.0, 0.0, 1.0], 4: [1.0, -0.0, 3.0, 6.0], 5: [2.0, 0.0, -1.0, -2.0], 6: [2.0, None, 3.0, 1.5], 7: [0.0]}


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zeros")
    rows = [(100 * u + k, u, k, "click", v) for u, values in VALUES.items() for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double").toPandas().to_parquet(folder / "events.parquet")
    return str(folder)


def test_rates_leave_out_what_follows_a_zero(spark, zeros):
    got, want = same(registry.QUERIES["convergence_rate"](spark, zeros), connect(zeros), registry.ORACLE_SQL["convergence_rate"])
    assert got == want and len(got) == 5


def test_uncapped_rates_take_infinite_ratios(spark, zeros):
    got, want = same(registry.QUERIES["convergence_rate_uncapped"](spark, zeros), connect(zeros), registry.ORACLE_SQL["convergence_rate_uncapped"])
    assert got == want and (2, float("inf"), 2) in got
