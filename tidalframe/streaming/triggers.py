"""Interval triggers over a stream of steps.

A step fires the output if its time has reached the next due time, at most once, and the next due
time moves by one interval without catching up. That needs the state of the run so far, so the
stream keeps one due time per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "key long, t double, due double"


def fired(times: list[float], interval: float, due: float) -> tuple[list[tuple[float, float]], float]:
    """(time, due time) of the steps that fire, and the next due time."""
    out = []
    for t in times:
        if t >= due:
            out.append((t, due))
            due += interval
    return out, due


def _update(interval: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due = state.get[0] if state.exists else interval
        times = sorted(t for b in batches for t in b["t"].tolist())
        out, due = fired(times, interval, due)
        state.update((due,))
        yield pd.DataFrame({"key": [key[0]] * len(out), "t": [t for t, _ in out], "due": [d for _, d in out]}).astype({"key": "int64", "t": "float64", "due": "float64"})

    return run


def triggers(steps: DataFrame, interval: float) -> DataFrame:
    """The steps (key, t) of a stream that fire; late steps fire if they have reached the due time."""
    return steps.groupBy("key").applyInPandasWithState(_update(interval), SCHEMA, "due double", "append", GroupStateTimeout.NoTimeout)


def triggers_batch(steps: DataFrame, interval: float) -> DataFrame:
    """The same over a finite table."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, _ = fired(sorted(rows["t"].tolist()), interval, interval)
        return pd.DataFrame({"key": [key[0]] * len(out), "t": [t for t, _ in out], "due": [d for _, d in out]}).astype({"key": "int64", "t": "float64", "due": "float64"})

    return steps.groupBy("key").applyInPandas(run, SCHEMA)


def windowed_diagnostics(steps: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling-window diagnostics of a stream (ts, value), with a watermark for late rows."""
    return steps.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("value").alias("n"), F.max("value").alias("most"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "n", "most", "mean")
