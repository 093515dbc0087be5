"""The adaptive fit against a dense constrained least squares of its own mesh, and its stops."""

from __future__ import annotations

import numpy as np
import pytest

from tidalframe.operators import adaptive

BOX = (0.0, 8.0, 0.0, 8.0)
SCHEMA = "id long, x double, y double, z double, w double"


def bump(x, y):
    return 3.0 * np.exp(-((x - 2.1) ** 2 + (y - 5.2) ** 2)) + 0.1 * x


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 8, 400), rng.uniform(0, 8, 400)
    rows = [(k, float(a), float(b), float(bump(a, b)), 1.0 + k % 3) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    return rows, spark.createDataFrame([*rows, (900, None, 1.0, 1.0, 1.0), (901, 1.0, 1.0, None, 1.0), (902, 99.0, 1.0, 1.0, 1.0), (903, 1.0, 1.0, 5.0, 0.0)], SCHEMA)


def dense(surface, rows, smoothing):
    """Corner values by position: misfit and slopes under the hanging conditions, all unknowns at once."""
    cells = [(r.leaf, r.xmin, r.xmax, r.ymin, r.ymax) for r in surface]
    spots = sorted({(x, y) for _, a, b, c, d in cells for x in (a, b) for y in (c, d)})
    at = {s: k for k, s in enumerate(spots)}
    n = len(spots)
    h, f = np.zeros((n, n)), np.zeros(n)
    stiff = np.array(adaptive.SLOPE).reshape(4, 4)
    for _, a, b, c, d in cells:
        k = [at[p] for p in ((a, c), (b, c), (a, d), (b, d))]
        h[np.ix_(k, k)] += smoothing * stiff
        mine = [r for r in rows if a <= r[1] <= b and c <= r[2] <= d]
        for _, x, y, z, w in mine:  # random samples lie on no edge
            u, v = (x - a) / (b - a), (y - c) / (d - c)
            t = np.array([(1 - u) * (1 - v), u * (1 - v), (1 - u) * v, u * v])
            h[np.ix_(k, k)] += w * np.outer(t, t)
            f[k] += w * z * t
    conditions = []
    for _, a, b, c, d in cells:
        for p, q in (((a, c), (b, c)), ((a, d), (b, d)), ((a, c), (a, d)), ((b, c), (b, d))):
            middle = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
            if middle in at:
                row = np.zeros(n)
                row[at[middle]], row[at[p]], row[at[q]] = 1.0, -0.5, -0.5
                conditions.append(row)
    g = np.array(conditions).reshape(-1, n)
    kkt = np.block([[h, g.T], [g, np.zeros((len(g), len(g)))]])
    x = np.linalg.lstsq(kkt, np.concatenate([f, np.zeros(len(g))]), rcond=None)[0]
    return {s: x[k] for s, k in at.items()}, len(g)


def test_each_round_is_the_dense_solution(samples):
    rows, frame = samples
    surface, history = adaptive.adaptive_fit(frame, BOX, 1, 4, threshold=0.05, theta=0.6, smoothing=0.01, most_rounds=3, tolerance=1e-8)
    assert [h.reason for h in history] == ["", "", "rounds"] and [h.round for h in history] == [0, 1, 2]
    assert abs(history[0].warm - 1) < 1e-9 and all(h.warm < 0.5 for h in history[1:])
    assert history[-1].most < history[0].most and history[-1].elements > history[0].elements == 4 and history[0].unknowns == 9
    held = surface.collect()
    want, conditions = dense(held, rows, 0.01)
    assert conditions > 0 and history[-1].unknowns == len(want) - conditions
    for r in held:
        for value, spot in zip(r.coefficients, ((r.xmin, r.ymin), (r.xmax, r.ymin), (r.xmin, r.ymax), (r.xmax, r.ymax)), strict=True):
            assert abs(value - want[spot]) < 1e-5


def test_stops(samples, spark):
    _, frame = samples
    assert adaptive.adaptive_fit(frame, BOX, 1, 3, threshold=99.0)[1][-1].reason == "threshold"
    assert adaptive.adaptive_fit(frame, BOX, 1, 3, threshold=0.0, most_elements=4)[1][-1].reason == "elements"
    assert adaptive.adaptive_fit(frame, BOX, 1, 1, threshold=0.0)[1][-1].reason == "nothing to refine"
    surface, history = adaptive.adaptive_fit(spark.createDataFrame([], SCHEMA), BOX, 1, 3, threshold=0.0)
    assert history[-1].reason == "threshold" and surface.count() == 4 and all(c == 0 for r in surface.collect() for c in r.coefficients)
