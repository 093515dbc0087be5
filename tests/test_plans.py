"""Marking, numbering and segments where data crowd: against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidalframe.operators import fit, large, mesh, spatial
from tidalframe.sources import tables


def brute_marks(values, theta):
    """The least set of the largest squares that reaches the share, and what ties with its last."""
    order = sorted(values, key=lambda r: -r[1])
    goal, total, cutoff = theta * sum(m * m for _, m in values), 0.0, None
    for _, m in order:
        if total < goal or cutoff is None:
            cutoff = m
        total += m * m
    return {e for e, m in values if m >= cutoff * (1 - 1e-12)}


@pytest.mark.parametrize("theta", [0.05, 0.5, 0.93])
@pytest.mark.parametrize("shape", ["flat", "wide", "ties", "tiny"])
def test_marking_of_crowded_metrics(spark, theta, shape):
    rng = random.Random(f"{theta}{shape}")
    value = {"flat": lambda: 1 + 1e-7 * rng.random(), "wide": lambda: 10 ** rng.uniform(-6, 6), "ties": lambda: rng.choice([1.0, 1.0001, 2.0]), "tiny": lambda: rng.random() * 1e-200}[shape]
    rows = [(k, value()) for k in range(400)]
    got = {r.e for r in fit.dorfler(spark.createDataFrame(rows, "e long, m double"), "e", "m", theta).collect()}
    want = brute_marks(rows, theta)
    assert got == want if shape != "tiny" else len(got) >= 1


def test_segments_meet_the_boxes_on_their_way(spark):
    rng = random.Random(3)
    lines = [(x := rng.uniform(-40, 140), y := rng.uniform(-40, 140), x + rng.choice([0.0, 1e-9, 80.0, -120.0, 7.0]), y + rng.choice([0.0, 90.0, -33.0, 5.0])) for _ in range(60)] + [(16.0, 0.0, 16.0, 100.0), (0.0, 32.0, 100.0, 32.0), (0.0, 0.0, 96.0, 96.0), (5.0, 5.0, 5.0, 5.0)]
    boxes = [(12 * j + i, 8.0 * i, 8.0 * i + 8, 8.0 * j, 8.0 * j + 8) for i in range(12) for j in range(12)]

    def meets(line, box):
        (x0, y0, x1, y1), (_, a, b, c, d) = line, box
        lo, hi = 0.0, 1.0
        for p, q, low, high in ((x0, x1, a, b), (y0, y1, c, d)):
            if p == q:
                if not low <= p <= high:
                    return False
                continue
            s, t = sorted(((low - p) / (q - p), (high - p) / (q - p)))
            lo, hi = max(lo, s), min(hi, t)
        return lo <= hi

    got = {r.id for r in spatial.boxes_on_segments(spark.createDataFrame(boxes, "id long, xmin double, xmax double, ymin double, ymax double"), spark.createDataFrame(lines, "x0 double, y0 double, x1 double, y1 double"), ("id",), 4.0).collect()}
    assert got == {b[0] for b in boxes if any(meets(line, b) for line in lines)}


def test_numbers_follow_the_order_in_a_crowded_corner(spark):
    cells = spark.range(3000).select(F.lit(12).alias("lx"), F.lit(12).alias("ly"), (F.col("id") % 64).alias("ix"), F.floor(F.col("id") / 64).cast("long").alias("iy"))
    rows = mesh.numbered(cells, 12).withColumn("p", mesh.path(12)).orderBy("leaf").collect()
    assert [r.leaf for r in rows] == list(range(3000)) and [r.p for r in rows] == sorted(r.p for r in rows)
    assert tables.ranked(cells.where("ix < 0"), ["ix"], "n").count() == 0


def test_jacobi_by_tables_is_jacobi(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    a = rng.normal(size=(12, 12)) * 0.2 + 4 * np.eye(12)
    b = rng.normal(size=12)
    matrix = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12)], "i long, j long, v double")
    load = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, v double")
    for sweeps in (0, 1, 2, 5):
        x = np.zeros(12)
        for _ in range(sweeps):
            x = x + 0.8 * (b - a @ x) / np.diag(a)
        got = np.array([r.v for r in fit.jacobi(matrix, load, sweeps).orderBy("i").collect()])
        assert np.allclose(got, x)
    assert not [t for t in spark.catalog.listTables() if "matrix_" in t.name]
    assert large.COARSE_MOST >= 256


def test_diffusion_evens_parts_and_loses_no_leaf(spark):
    cells = mesh.numbered(mesh.uniform(spark, 5, 5), 5).cache()
    near = mesh.adjacency(cells, 5).cache()
    start = cells.select("leaf", F.when(F.col("ix") < 24, 0).when(F.col("ix") < 28, 1).otherwise(2).alias("part"))
    after = mesh.diffuse(start, near, 0.1, 40)
    rows = after.collect()
    assert sorted(r.leaf for r in rows) == list(range(1024))
    sizes = lambda rows: sorted(sum(r.part == p for r in rows) for p in (0, 1, 2))
    assert sizes(start.collect()) == [128, 128, 768] and sizes(rows)[-1] < 600  # the middle part takes until it has the mean
    even = cells.select("leaf", (F.col("leaf") % 4).alias("part"))
    assert sorted(map(tuple, mesh.diffuse(even, near).collect())) == sorted(map(tuple, even.collect()))
    assert mesh.diffuse(even.where("leaf < 0"), near).collect() == []
