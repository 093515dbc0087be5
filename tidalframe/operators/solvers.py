"""Linear solvers: many bounded systems at once, or one of any size.

``solve_each`` deals systems by their key; each is a dense numpy problem in the task that holds it, refused above ``MOST`` unknowns,
so what runs in parallel are systems. ``distributed_cg`` is for one system of any size: products are joins, and every
iteration is one table in the shared folder, so a lost executor costs one iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.operators import fit
from tidalframe.sources.tables import materialise

#: Unknowns of one system in a task (32 MB as a dense matrix).
MOST = 2048


def iterate(step: Callable[[np.ndarray], np.ndarray], matrix: np.ndarray, b: np.ndarray, tolerance: float = 1e-12, most: int = 2000) -> tuple[np.ndarray, list[float]]:
    """Repeat ``step`` from zero until the residual is ``tolerance`` of the first; solution and residual norms."""
    x = np.zeros_like(b)
    history = [float(np.linalg.norm(b))]
    while history[-1] > tolerance * max(history[0], 1e-300) and len(history) <= most:
        x = step(x)
        history.append(float(np.linalg.norm(b - matrix @ x)))
    return x, history


def chain_blocks(n: int) -> list[list[int]]:
    """Blocks of neighbours that overlap by one unknown."""
    return [[k, k + 1] for k in range(n - 1)] or [[0]]


def coarse_maps(n: int) -> list[np.ndarray]:
    """Prolongations of a chain by linear interpolation, until three unknowns or fewer are left."""
    out = []
    while n > 3:
        m = (n - 1) // 2
        p = np.zeros((n, m))
        for k in range(m):
            p[2 * k : 2 * k + 3, k] = (0.5, 1.0, 0.5)
        out.append(p)
        n = m
    return out


def solved(method: str, matrix: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Solution and residual norms by a method's name."""
    n = len(b)
    if method == "direct":
        x = np.linalg.solve(matrix, b)
        return x, [float(np.linalg.norm(b)), float(np.linalg.norm(b - matrix @ x))]
    diagonal = np.diag(matrix)
    if method in ("cg", "pcg", "fcg"):
        precondition = None if method == "cg" else lambda r: r / diagonal
        return fit.conjugate_gradients(lambda p: matrix @ p, b, precondition, 1e-13, flexible=method == "fcg")
    if method == "jacobi":
        return iterate(lambda x: x + 0.8 * (b - matrix @ x) / diagonal, matrix, b)
    if method.startswith("schwarz_"):
        kind = method.removeprefix("schwarz_")
        blocks = chain_blocks(n)
        omega = 0.5 if kind == "additive" else 1.0
        return iterate(lambda x: x + fit.schwarz(matrix, b - matrix @ x, blocks, kind, omega), matrix, b)
    if method == "multigrid":
        up = coarse_maps(n)
        levels = fit.galerkin(matrix, up)
        return iterate(lambda x: x + fit.v_cycle(levels, up, b - matrix @ x), matrix, b)
    raise ValueError(f"unknown method {method!r}")


def _dense(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unknowns, matrix and right side from rows (i, j, v); the right side has no j."""
    i, v = table.column("i").to_numpy(), table.column("v").to_numpy()
    load = table.column("j").is_null().to_numpy(zero_copy_only=False)
    j = table.column("j").fill_null(0).to_numpy()
    ids = np.unique(i)
    if len(ids) > MOST:
        raise ValueError(f"{len(ids)} unknowns; a system of a task has at most {MOST}")
    b, dense = np.zeros(len(ids)), np.zeros((len(ids), len(ids)))
    np.add.at(b, np.searchsorted(ids, i[load]), v[load])
    np.add.at(dense, (np.searchsorted(ids, i[~load]), np.searchsorted(ids, j[~load])), v[~load])
    return ids, dense, b


def _rows(matrix: DataFrame, load: DataFrame, key: str) -> DataFrame:
    return matrix.select(key, "i", "j", "v").unionByName(load.select(key, "i", F.lit(None).cast("long").alias("j"), "v"))


def solve_each(matrix: DataFrame, load: DataFrame, key: str, method: str = "direct") -> DataFrame:
    """(key, i, v, iterations) of the systems (key, i, j, v) with right sides (key, i, v)."""

    def run(table: pa.Table) -> pa.Table:
        ids, dense, b = _dense(table)
        x, history = solved(method, dense, b)
        return pa.table({key: [table.column(key)[0].as_py()] * len(ids), "i": ids, "v": x, "iterations": np.full(len(ids), len(history) - 1)})

    return _rows(matrix, load, key).groupBy(key).applyInArrow(run, f"{key} long, i long, v double, iterations long")


def histories(matrix: DataFrame, load: DataFrame, key: str, method: str) -> DataFrame:
    """(key, iteration, residual, relative) of each system's way to its solution."""

    def run(table: pa.Table) -> pa.Table:
        _, dense, b = _dense(table)
        history = np.array(solved(method, dense, b)[1])
        return pa.table({key: [table.column(key)[0].as_py()] * len(history), "iteration": np.arange(len(history)), "residual": history, "relative": history / max(history[0], 1e-300)})

    return _rows(matrix, load, key).groupBy(key).applyInArrow(run, f"{key} long, iteration long, residual double, relative double")


def schur_preconditioner(q: np.ndarray, a: np.ndarray, kind: str, blocks: Sequence[Sequence[int]]) -> Callable[[np.ndarray], np.ndarray] | None:
    """An approximation of (A Q^-1 A')^-1: with Q's diagonal, or with its diagonal blocks."""
    if kind == "none":
        return None
    if kind == "diagonal":
        near = (a / np.diag(q)) @ a.T
    else:
        inverse = np.zeros_like(q)
        for block in blocks:
            at = np.ix_(block, block)
            inverse[at] = np.linalg.inv(q[at])
        near = a @ inverse @ a.T
    return lambda r: np.linalg.solve(near, r)


def schur_each(matrix: DataFrame, load: DataFrame, constraints: DataFrame, key: str, kind: str = "none", block: int = 2) -> DataFrame:
    """(key, i, v, iterations): minimisers of x'Qx/2 - b'x under each system's constraint rows (key, row, i, v) = 0.

    Conjugate gradients on A Q^-1 A', preconditioned by ``kind``: none, diagonal or block (of ``block`` unknowns each).
    """

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        ids, q, b = _dense(table.filter(pa.array(kinds == 0)))
        rows = table.filter(pa.array(kinds == 1))
        names, at = np.unique(rows.column("j").to_numpy(), return_inverse=True)
        a = np.zeros((len(names), len(ids)))
        np.add.at(a, (at, np.searchsorted(ids, rows.column("i").to_numpy())), rows.column("v").to_numpy())
        blocks = [list(range(k, min(k + block, len(ids)))) for k in range(0, len(ids), block)]
        x, history = fit.schur_solve(q, a, b, precondition=schur_preconditioner(q, a, kind, blocks))
        return pa.table({key: [table.column(key)[0].as_py()] * len(ids), "i": ids, "v": x, "iterations": np.full(len(ids), len(history) - 1)})

    every = _rows(matrix, load, key).withColumn("kind", F.lit(0)).unionByName(constraints.select(key, "i", F.col("row").cast("long").alias("j"), "v", F.lit(1).alias("kind")))
    return every.groupBy(key).applyInArrow(run, f"{key} long, i long, v double, iterations long")


def distributed_cg(matrix: DataFrame, load: DataFrame, tolerance: float = 1e-12, most: int = 1000) -> tuple[DataFrame, list[float]]:
    """(i, v) and residual norms of one system by conjugate gradients with a diagonal preconditioner."""
    from tidalframe.operators import large

    return large.conjugate_gradients(matrix, load, tolerance=tolerance, most=most)
