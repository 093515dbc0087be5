"""Time stepping and adaptive loops: driver loops over small states or over relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rate = Callable[[float, np.ndarray], np.ndarray]

# Published tableaus (nodes, stage rows, weights).
TABLEAUS = {
    "euler": ((0.0,), ((),), (1.0,)),
    "rk2": ((0.0, 0.5), ((), (0.5,)), (0.0, 1.0)),
    "ssprk3": ((0.0, 1.0, 0.5), ((), (1.0,), (0.25, 0.25)), (1 / 6, 1 / 6, 2 / 3)),
    "rk4": ((0.0, 0.5, 0.5, 1.0), ((), (0.5,), (0.0, 0.5), (0.0, 0.0, 1.0)), (1 / 6, 1 / 3, 1 / 3, 1 / 6)),
    "dopri5": (
        (0.0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1.0),
        ((), (1 / 5,), (3 / 40, 9 / 40), (44 / 45, -56 / 15, 32 / 9), (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729), (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656)),
        (35 / 384, 0.0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84),
    ),
}
# The five-stage, fourth-order low-storage scheme of Carpenter and Kennedy (1994).
LOW_STORAGE_A = (0.0, -567301805773 / 1357537059087, -2404267990393 / 2016746695238, -3550918686646 / 2091501179385, -1275806237668 / 842570457699)
LOW_STORAGE_B = (1432997174477 / 9575080441755, 5161836677717 / 13612068292357, 1720146321549 / 2090206949498, 3134564353537 / 4481467310338, 2277821191437 / 14882151754819)
LOW_STORAGE_C = (0.0, 1432997174477 / 9575080441755, 2526269341429 / 6820363962896, 2006345519317 / 3224310063776, 2802321613138 / 2924317926251)


def step(kind: str, rate: Rate, t: float, y: np.ndarray, dt: float) -> np.ndarray:
    """One explicit step."""
    if kind == "lsrk45":
        k = np.zeros_like(y)
        for a, b, c in zip(LOW_STORAGE_A, LOW_STORAGE_B, LOW_STORAGE_C, strict=True):
            k = a * k + dt * rate(t + c * dt, y)
            y = y + b * k
        return y
    nodes, rows, weights = TABLEAUS[kind]
    slopes: list[np.ndarray] = []
    for c, row in zip(nodes, rows, strict=True):
        slopes.append(rate(t + c * dt, y + dt * sum((a * s for a, s in zip(row, slopes, strict=False)), np.zeros_like(y))))
    return y + dt * sum(w * s for w, s in zip(weights, slopes, strict=True))


def step_columns(kind: str, rate: Callable[[Column, Column], Column], t: str, y: str, dt: float) -> Column:
    """One explicit step of many independent equations, as a column expression."""
    nodes, rows, weights = TABLEAUS[kind]
    slopes: list[Column] = []
    for c, row in zip(nodes, rows, strict=True):
        at = F.col(y)
        for a, s in zip(row, slopes, strict=False):
            at = at + dt * a * s
        slopes.append(rate(F.col(t) + c * dt, at))
    out = F.col(y)
    for w, s in zip(weights, slopes, strict=True):
        out = out + dt * w * s
    return out


def imex_euler(explicit: Rate, implicit: np.ndarray, t: float, y: np.ndarray, dt: float) -> np.ndarray:
    """Explicit Euler for one part, implicit Euler for a linear one."""
    return np.linalg.solve(np.eye(len(y)) - dt * implicit, y + dt * explicit(t, y))


@dataclass
class Round:
    """One line of an adaptive run's history."""

    iteration: int
    elements: int
    most: float
    mean: float
    marked: int
    reason: str


def adapt(mesh: DataFrame, measure: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame, DataFrame], DataFrame], key: str, metric: str, theta: float, threshold: float, most_elements: int, most_rounds: int) -> tuple[DataFrame, list[Round]]:
    """Estimate, mark and refine until the error, the size or the number of rounds says stop.

    Each round's mesh is a table in the shared folder; the driver holds one line a round.
    """
    from tidalframe.operators.fit import dorfler
    from tidalframe.sources.tables import materialise

    history: list[Round] = []
    for k in range(most_rounds):
        found = materialise(measure(mesh), "estimate")
        count, top, mean = found.agg(F.count(key), F.max(metric), F.avg(metric)).first()
        reason = "threshold" if top <= threshold else "elements" if count >= most_elements else ""
        marked = None if reason else materialise(dorfler(found, key, metric, theta), "marked")
        n = 0 if marked is None else marked.count()
        reason = reason or ("" if n else "nothing to refine") or ("rounds" if k == most_rounds - 1 else "")
        history.append(Round(k, count, top, mean, n, reason))
        if reason:
            break
        mesh = materialise(refine(mesh, marked), "mesh")
    return mesh, history


def split_modes(state: DataFrame, weights, dt: float, substeps: int, depth: float, gravity: float = 9.81, drag: float = 0.0) -> DataFrame:
    """One split step of columns (elem, i, j, k, u, eta): the mean flow in short steps, the rest as it was.

    The mean feels the surface level's relaxation and drag in ``substeps`` predictor-corrector
    steps; the surface level is averaged over them. There are no terms across columns.
    """
    from pyspark.sql import Window

    from tidalframe.operators.column import KEY, by_k

    w, column = by_k(weights), Window.partitionBy(*KEY)
    mean = F.sum(w * F.col("u")).over(column) / F.sum(w).over(column)
    short = dt / substeps

    def advance(s: Column) -> Column:
        level, flow = s["eta"], s["u"]
        guess = flow - short * (gravity * level / depth + drag * flow)
        middle = level - short * depth * (flow + guess) / 2.0 / 1e3
        return F.struct(middle.alias("eta"), (flow - short * (gravity * (level + middle) / 2.0 / depth + drag * (flow + guess) / 2.0)).alias("u"), (s["sum"] + middle).alias("sum"))

    start = F.struct(F.col("eta").alias("eta"), F.col("mean").alias("u"), F.lit(0.0).alias("sum"))
    rows = state.withColumn("mean", mean).withColumn("end", F.aggregate(F.sequence(F.lit(1), F.lit(substeps)), start, lambda s, _: advance(s)))
    return rows.select(*KEY, "k", (F.col("end.u") + F.col("u") - F.col("mean")).alias("u"), (F.col("end.sum") / substeps).alias("eta"))
