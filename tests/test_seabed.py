"""Meshes from points and the seabed under them: grading, location, depth, slopes, hanging edges."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidalframe.functions import basis
from tidalframe.operators import mesh, seabed

BOX = (0.0, 16.0, 0.0, 16.0)
LEVELS = (1, 2, 3, 4)


def cells_of(frame):
    return {(r.lx, r.ix, r.iy) for r in frame.collect()}


@pytest.fixture(scope="module")
def points(spark):
    rows = [(k, 0.2 + 0.01 * k, 0.3) for k in range(12)] + [(20, 16.0, 16.0), (21, 15.9, 15.9), (22, None, 1.0), (23, -1.0, 2.0), (24, 8.0, 8.0), (25, 8.0, 8.0)]
    return spark.createDataFrame(rows, "id long, x double, y double")


def brute(points, most, graded):
    held = {}
    for _, x, y in points:
        if x is None or y is None or not (0 <= x <= 16 and 0 <= y <= 16):
            continue
        for level in LEVELS:
            c = tuple(min(int(v * (1 << level) / 16), (1 << level) - 1) for v in (x, y))
            held[(level, *c)] = held.get((level, *c), 0) + 1
    split = {c for c, n in held.items() if n > most and c[0] < 4}
    todo = list(split) if graded else []
    while todo:
        k, i, j = todo.pop()
        for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            up = (k - 1, (i + a) >> 1, (j + b) >> 1)
            if k > 1 and 0 <= i + a < 1 << k and 0 <= j + b < 1 << k and up not in split:
                split.add(up)
                todo.append(up)
    every = {(1, i, j) for i in (0, 1) for j in (0, 1)} | {(k + 1, 2 * i + a, 2 * j + b) for k, i, j in split for a in (0, 1) for b in (0, 1)}
    return every - split


@pytest.mark.parametrize("graded", [True, False])
@pytest.mark.parametrize("most", [0, 1, 3, 100])
def test_mesh_of_points_is_brute_force(spark, points, most, graded):
    got = cells_of(mesh.from_points(points, BOX, 1, 4, most, graded))
    assert got == brute([tuple(r) for r in points.collect()], most, graded)


def test_mesh_of_nothing_is_the_base(spark, points):
    assert cells_of(mesh.from_points(points.where("id < 0"), BOX, 1, 4, 2)) == {(1, i, j) for i in (0, 1) for j in (0, 1)}
    cubes = mesh.octree_from_points(points.where("id < 0").withColumn("z", F.lit(0.0)), (*BOX, 0.0, 1.0), 1, 3, 2)
    assert cubes.count() == 8 and cubes.select("leaf").distinct().count() == 8


def test_octree_volume_and_location(spark):
    rows = [(k, (k * 7 % 16) + 0.5, (k * 5 % 16) + 0.25, (k * 3 % 16) + 0.125) for k in range(64)] + [(100, 8.0, 8.0, 8.0), (101, 99.0, 1.0, 1.0), (102, None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    box = (*BOX, 0.0, 16.0)
    cubes = mesh.octree_from_points(points, box, 1, 3, 4)
    held = {r.leaf: r for r in cubes.collect()}
    assert sum(8.0 ** -r.level for r in held.values()) == 1.0
    found = {r.id: r.leaf for r in mesh.locate(points, cubes.withColumnRenamed("level", "lx"), box, (1, 2, 3), ("id",), ("x", "y", "z")).collect()}
    for i, *at in rows:
        if None in at:
            assert found[i] == -1
            continue
        inside = [leaf for leaf, r in held.items() if all(c * 16 / (1 << r.level) <= v <= (c + 1) * 16 / (1 << r.level) for c, v in zip((r.ix, r.iy, r.iz), at, strict=True))]
        assert found[i] == min(inside, default=-1)


def patched(spark, points, z):
    """Cubic patches over the graded mesh of the points, coefficients by position of the control points."""
    leaves = mesh.with_boxes(mesh.numbered(mesh.from_points(points, BOX, 1, 4, 1), 4), BOX)
    x = lambda k: F.col("xmin") + (k % 4) / 3.0 * (F.col("xmax") - F.col("xmin"))
    y = lambda k: F.col("ymin") + (k // 4) / 3.0 * (F.col("ymax") - F.col("ymin"))
    return leaves.withColumn("coefficients", F.array(*[z(x(k), y(k), k) for k in range(16)])).cache()


ASK = "id long, x double, y double, leaf int, depth string"


def test_plane_is_met_exactly_and_outside_is_nothing(spark, points):
    plane = patched(spark, points, lambda x, y, k: 20.0 + 0.6 * x - 0.25 * y)
    at = [(1, 3.3, 4.4), (2, 8.0, 8.0), (3, 0.0, 0.0), (4, 16.0, 16.0), (5, 8.0, 1.0), (6, 16.1, 1.0), (7, None, 1.0), (8, float("nan"), 1.0), (1, 3.3, 4.4)]
    got = seabed.evaluate(spark.createDataFrame([(*a, 9, "clash") for a in at], ASK), plane, BOX, LEVELS, ("id", "x", "y"), 3).collect()
    for r in got:
        if r.id in (6, 7, 8):
            assert (r.element, r.found, r.depth, r.dh_dx, r.dh_dy) == (-1, False, 0.0, 0.0, 0.0)
        else:
            assert r.found and r.element >= 0
            assert math.isclose(r.depth, 20 + 0.6 * r.x - 0.25 * r.y, abs_tol=1e-12) and math.isclose(r.dh_dx, 0.6, abs_tol=1e-12) and math.isclose(r.dh_dy, -0.25, abs_tol=1e-12)
    assert len(got) == 9
    nothing = spark.createDataFrame([], ASK)
    assert seabed.evaluate(nothing, plane, BOX, LEVELS, ("id",), 3).collect() == []


def test_slope_across_a_kink_is_the_mean_of_both_sides(spark, points):
    kink = patched(spark, points, lambda x, y, k: F.when(x <= 8, x).otherwise(8 + 3 * (x - 8)))
    at = [(1, 8.0, 3.0), (2, 7.5, 3.0), (3, 8.5, 3.0), (4, 16.0, 3.0), (5, 0.0, 3.0)]
    got = {r.id: (r.depth, r.dh_dx, r.dh_dy) for r in seabed.evaluate(spark.createDataFrame([(*a, 0, "") for a in at], ASK), kink, BOX, LEVELS, ("id",), 3).collect()}
    want = {1: (8.0, 2.0), 2: (7.5, 1.0), 3: (9.5, 3.0), 4: (32.0, 3.0), 5: (0.0, 1.0)}
    assert all(math.isclose(got[k][0], h, abs_tol=1e-12) and math.isclose(got[k][1], s, abs_tol=1e-12) and abs(got[k][2]) < 1e-12 for k, (h, s) in want.items())


def test_hanging_edges_agree_after_conforming(spark, points):
    rough = patched(spark, points, lambda x, y, k: F.sin(x * 3 + F.lit(k)) + y)
    near = mesh.adjacency(rough, 4).cache()
    out = seabed.conform(rough.select("leaf", F.posexplode("coefficients").alias("k", "z")), rough, near, LEVELS, 3)
    z = {(r.leaf, r.k): r.z for r in out.collect()}
    old = {(r.leaf, k): v for r in rough.collect() for k, v in enumerate(r.coefficients)}
    assert set(z) == set(old)
    box = {r.leaf: (r.xmin, r.xmax, r.ymin, r.ymax) for r in rough.collect()}
    place = lambda e, k: {0: 4 * k, 1: 4 * k + 3, 2: k, 3: k + 12}[e]
    edge = lambda leaf, e: [z[(leaf, place(e, k))] for k in range(4)]
    value = lambda c, u: sum(math.comb(3, k) * u**k * (1 - u) ** (3 - k) * v for k, v in enumerate(c))
    pairs = near.where("kind = 'fine_to_coarse'").collect()
    claimed = {}
    for r in pairs:
        for k in range(4):
            claimed.setdefault((r.leaf, place(r.edge, k)), []).append(r.edge)
    for r in pairs:
        lo, hi = (box[r.leaf][2:], box[r.neighbour][2:]) if r.edge < 2 else (box[r.leaf][:2], box[r.neighbour][:2])
        free = all(claimed[(r.leaf, place(r.edge, k))] == [r.edge] for k in range(4))
        if free:
            for u in (0.0, 0.3, 1.0):
                at = lo[0] + u * (lo[1] - lo[0])
                assert math.isclose(value(edge(r.leaf, r.edge), u), value(edge(r.neighbour, r.neighbour_edge), (at - hi[0]) / (hi[1] - hi[0])), abs_tol=1e-9)
    touched = set(claimed)
    assert all(z[c] == old[c] for c in z if c not in touched) and len(pairs) > 4
    assert basis.extraction(3, 0).shape == (4, 4)
