"""Ball trees and hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests.oracle import connect, same
from tidalframe.llm import ball_tree, hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, query int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 3, "clash") for i, v, y in rows], SCHEMA)


def brute(rows, every=100, relabel=7):
    """All pairs in Python's integers."""
    fit = [(i, (y + 1) % 10 if i % relabel == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))  # missing components are zero
    out = []
    for i, y, v in fit:
        if i % every:
            continue
        order = sorted((-dot(v, w), j, z) for j, z, w in fit if j != i)
        for s, j, _ in [r for r in order if r[2] == y][:5]:
            fits = [r for r in order if r[2] != y and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(i, j, k + 1, c, -s, -t) for k, (t, c, _) in enumerate(fits)]
    return sorted(out)


def mined(df, **more):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in columns) for r in hard_negatives.hard_negatives(df, relabel_every=7, **more).collect())


def odd_rows():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 6))
    rows = [(k, (middle[k % 12] + 0.4 * rng.normal(size=6)).tolist(), k % 4) for k in range(700)]
    rows += [(900 + k, [0.25] * 6, k % 3) for k in range(40)]  # ties
    rows += [(1000, None, 1), (1001, [1.0, None, 2.0], 1), (1002, [math.nan] * 6, 1), (1003, [math.inf] * 6, 2), (1004, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(1100, [], 2), (1200, [0.5, 0.5], 1), (1300, [0.0] * 6, 1), (1400, [-3.0] * 6, 9), (1401, [-3.0] * 6, 9)]
    return rows + [(1500, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0], 3)] * 2 + [(301, rows[301][1], 1)] * 3


@pytest.mark.parametrize(("tree", "block"), [(8192, 4096), (97, 3)])
def test_odd_vectors_match_brute_force(spark, monkeypatch, tree, block):
    monkeypatch.setattr(hard_negatives, "TREE_ROWS", tree)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = odd_rows()
    want = brute(rows)
    assert mined(frame(spark, rows).repartition(3)) == want
    assert len(want) > 200


def test_hot_label_and_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=4).tolist(), 0 if k % 50 else 1) for k in range(400)]
    assert mined(frame(spark, rows)) == brute(rows)
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(100, [1.0], 1)])) == []
    assert mined(frame(spark, [(None, None, None)])) == []


def test_scores_beyond_doubles_are_exact():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(5, 9)) * 2.0**29)
    want = [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in x.tolist()] for p in x.tolist()]
    assert ball_tree.scores(x, x).tolist() == want
    huge = np.array([[1e200, 0.0], [-1e200, 1.0]])
    ends = np.iinfo(np.int64)
    assert ball_tree.scores(huge, huge).tolist() == [[ends.max, ends.min + 1], [ends.min + 1, ends.max]]


def test_large_components_match_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(k, (rng.normal(size=3) * 2e6).tolist(), k % 3) for k in range(300)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_nodes_cover_their_rows_and_bounds_hold():
    rng = np.random.default_rng(8)
    rows, labels = np.floor(256 * rng.normal(size=(1000, 8))), rng.integers(0, 5, 1000)
    tree = ball_tree.build(np.arange(1000), labels, rows, 32)
    assert sorted(tree.ids.tolist()) == list(range(1000))
    assert (rows[tree.ids] == tree.rows).all() and (labels[tree.ids] == tree.labels).all()
    for a, b, c, r, lo, hi in zip(tree.lo, tree.hi, tree.centre, tree.radius, tree.least, tree.most, strict=True):
        assert np.sqrt(((tree.rows[a:b] - c) ** 2).sum(axis=1)).max() <= r + 1e-9
        assert (tree.labels[a:b].min(), tree.labels[a:b].max()) == (lo, hi)
    leaves = tree.left < 0
    assert (tree.hi - tree.lo)[leaves].max() <= 32 and (tree.hi - tree.lo)[leaves].sum() == 1000


def test_bounds_leave_out_far_nodes():
    """On clustered rows most are never scored."""
    rng = np.random.default_rng(9)
    rows = np.floor(256 * (8 * rng.normal(size=(40, 3))[np.arange(8000) % 40] + 0.05 * rng.normal(size=(8000, 3))))
    labels = np.arange(8000) % 2
    tree = ball_tree.build(np.arange(8000), labels, rows, 64)
    anchors = rows[:20]
    ends = np.iinfo(np.int64)
    search = ball_tree.Search(anchors, np.arange(20), labels[:20], np.arange(20), np.full(20, ends.min), np.full(20, ends.max), 5, True)
    search.visit(tree)
    got = {}
    for q, s, i in zip(*search.results(), strict=True):
        got.setdefault(int(q), []).append((-int(s), int(i)))
    score = (rows @ anchors.T).astype(np.int64)
    for q in range(20):
        fits = [k for k in range(8000) if k != q and labels[k] == labels[q]]
        assert sorted(got[q]) == sorted((-int(score[k, q]), k) for k in fits)[:5]
    assert search.looked < 0.35 * 20 * 8000


def test_registered_query(spark, sf_dir):
    got, want = same(queries.op12_hard_negatives(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op12_hard_negatives"])
    assert got == want and got
