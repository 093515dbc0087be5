"""Large systems on tables against numpy: their solutions, and that the methods are what does the work."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import fit, large

SIDE = 12


def dense_laplacian(shift):
    n = SIDE * SIDE
    a = np.zeros((n, n))
    for k in range(n):
        for d, ok in ((1, k % SIDE < SIDE - 1), (SIDE, k + SIDE < n)):
            if ok:
                a[k, k] += 1
                a[k + d, k + d] += 1
                a[k, k + d] = a[k + d, k] = -1
    return a + shift * np.eye(n)


def frame(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(p), int(q), float(a[p, q])) for p, q in zip(i, j, strict=True)], "i long, j long, v double").cache()


def vector(spark, b):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(b)], "i long, v double").cache()


def values(df):
    return np.array([r.v for r in df.orderBy("i").collect()])


@pytest.fixture(scope="module")
def system(spark):
    a = dense_laplacian(0.3)
    x = np.sin(np.arange(len(a)))
    return a, x, frame(spark, a), vector(spark, a @ x)


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.range(SIDE * SIDE).select((F.floor(F.col("id") / SIDE / 4) * 3 + F.floor(F.col("id") % SIDE / 4)).cast("long").alias("block"), F.col("id").alias("i")).cache()


def test_conjugate_gradients_and_a_warm_start(spark, system):
    a, x, matrix, load = system
    got, history = large.conjugate_gradients(matrix, load, tolerance=1e-10)
    assert np.abs(values(got) - x).max() < 1e-7 and history[-1] <= 1e-10 * np.linalg.norm(a @ x)
    near, short = large.conjugate_gradients(matrix, load, start=vector(spark, x + 1e-6), tolerance=1e-10)
    assert len(short) < len(history) and np.abs(values(near) - x).max() < 1e-7
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("matrix_")]


def test_additive_schwarz_is_the_sum_of_block_inverses(spark, system, blocks):
    a, x, matrix, load = system
    wide = large.overlapped(matrix, blocks).cache()
    members = {}
    for r in wide.collect():
        members.setdefault(r.block, []).append(r.i)
    want = np.zeros_like(a)
    for ids in members.values():
        ids = sorted(ids)
        want[np.ix_(ids, ids)] += np.linalg.inv(a[np.ix_(ids, ids)])
    m = large.additive_schwarz(matrix, wide)
    got = np.zeros_like(a)
    for r in m.collect():
        got[r.i, r.j] = r.v
    assert np.allclose(got, want, atol=1e-12) and len(members) == 9
    plain = large.conjugate_gradients(matrix, load, tolerance=1e-8)[1]
    solved, history = large.conjugate_gradients(matrix, load, lambda r: fit.matvec(m, r), tolerance=1e-8)
    large.drop(m)
    assert len(history) < len(plain) and np.abs(values(solved) - x).max() < 1e-6
    with pytest.raises(Exception, match="at most 3"):
        large.block_inverses(matrix, blocks, 3).count()


def test_colours_differ_across_edges(spark, system, blocks):
    _, _, matrix, _ = system
    colour = {r.i: r.colour for r in large.coloured(matrix).collect()}
    edges = [(r.i, r.j) for r in matrix.where("i <> j").collect()]
    assert len(colour) == SIDE * SIDE and all(colour[i] != colour[j] for i, j in edges) and max(colour.values()) <= 4
    lonely = spark.createDataFrame([(1, 1), (2, 2), (3, 4)], "i long, j long")
    got = {r.i: r.colour for r in large.coloured(lonely).collect()}
    assert got[1] == got[2] == 0 and {got[3], got[4]} == {0, 1}
    assert large.coloured(lonely.where("i > 9")).collect() == []
    conflicts = {(r.i, r.j) for r in large.block_conflicts(matrix, blocks).collect()}
    assert (0, 1) in conflicts and (0, 3) in conflicts and (0, 4) not in conflicts


def test_coloured_sweeps_are_block_gauss_seidel(spark, system, blocks):
    a, x, matrix, load = system
    b = a @ x
    colours = {r.i: r.colour for r in large.coloured(large.block_conflicts(matrix, blocks)).collect()}
    members = {}
    for r in blocks.collect():
        members.setdefault(r.block, []).append(r.i)
    want = np.zeros(len(b))
    for c in sorted(set(colours.values())):
        residual = b - a @ want
        for k, ids in members.items():
            if colours[k] == c:
                want[ids] += np.linalg.solve(a[np.ix_(ids, ids)], residual[ids])
    assert np.allclose(values(large.multiplicative_schwarz(matrix, load, blocks, 1)), want, atol=1e-10)


def test_galerkin_and_multigrid(spark, system):
    a, x, matrix, load = system
    cell = lambda step: (F.floor(F.col("id") / SIDE / step) * (SIDE // step) + F.floor(F.col("id") % SIDE / step)).cast("long")
    p1 = spark.range(SIDE * SIDE).select(F.col("id").alias("i"), cell(2).alias("c"), F.lit(1.0).alias("w"))
    p2 = spark.range(36).select(F.col("id").alias("i"), (F.floor(F.col("id") / 6 / 2) * 3 + F.floor(F.col("id") % 6 / 2)).cast("long").alias("c"), F.lit(1.0).alias("w"))
    dense = np.zeros((SIDE * SIDE, 36))
    for r in p1.collect():
        dense[r.i, r.c] = r.w
    coarse = np.zeros((36, 36))
    for r in large.galerkin(matrix, p1).collect():
        coarse[r.i, r.j] = r.v
    assert np.allclose(coarse, dense.T @ a @ dense)
    grid = large.Multigrid(matrix, [p1, p2])
    plain = large.conjugate_gradients(matrix, load, tolerance=1e-6)[1]
    solved, history = large.conjugate_gradients(matrix, load, grid, tolerance=1e-6)
    grid.close()
    assert len(history) < len(plain) and np.abs(values(solved) - x).max() < 1e-4


def test_schur_solves_the_constrained_system(spark):
    rng = np.random.default_rng(5)
    n, m = 20, 4
    q = np.diag(rng.uniform(2, 4, n)) + 0.1
    a = np.zeros((m, n))
    for k in range(m):
        a[k, 5 * k : 5 * k + 3] = [1.0, -2.0, 1.0]
    b, c = rng.normal(size=n), rng.normal(size=m)
    whole = np.block([[q, a.T], [a, np.zeros((m, m))]])
    want = np.linalg.solve(whole, np.concatenate([b, c]))
    rows = frame(spark, a).select(F.col("i").alias("row"), F.col("j").alias("col"), "v")
    x, multipliers, history = large.schur(frame(spark, q), rows, vector(spark, b), vector(spark, c), tolerance=1e-8)
    assert np.allclose(values(x), want[:n], atol=1e-6) and np.allclose(values(multipliers), want[n:], atol=1e-5) and 2 <= len(history) <= m + 2
