"""A robust-pruned flat graph over unit vectors, and the range-expanding greedy search on it, in numpy.

Every node has up to ``NEAR`` links to close nodes and up to ``FAR`` to nodes on the way to it that are much farther
(``BEYOND`` times the squared distance of the farthest close one). Both lists are robust-pruned: a candidate goes if a link
already chosen is closer to it than the node is, by ``alpha``. So clumps of more than ``NEAR`` nearly equal vectors keep
their links to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NEAR, FAR = 18, 6
BEAM = 24
MEDOIDS = 8
ALPHA = 1.2
BEYOND = 2.0
#: Steps that a query takes in any case, and how much wider than the range, in radians, it looks then.
PATIENCE, REACH = 16, 0.35
#: Queries that walk together, and bytes of vectors gathered in one go.
TOGETHER, GATHER_BYTES = 1024, 24 << 20


def _dots(x: np.ndarray, q: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Dot product of each row of ``q`` with the rows of ``x`` that its row of ``to`` names; -2 for none (-1)."""
    out = np.empty(to.shape, dtype=np.float32)
    step = max(1, GATHER_BYTES // max(1, to.shape[1] * x.shape[1] * 4))
    for lo in range(0, len(q), step):
        out[lo : lo + step] = np.einsum("qd,qkd->qk", q[lo : lo + step], x[to[lo : lo + step]])
    out[to < 0] = -2
    return out


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, least: float = 2.0, beam: int = BEAM, floor: np.ndarray | float = -2.0) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Greedy search: (best nodes, nodes expanded on the way, nodes met in range, nodes seen by each query).

    ``start`` holds each query's entry points, -1 for none. In range is what has a dot product of ``least`` or
    more, whether or not it is among the best; listed as (queries, nodes). After ``PATIENCE`` steps a query goes
    on only from nodes with a dot product of its ``floor`` or more.
    """
    n, count = len(x), len(q)
    seen = np.zeros((count, n + 1), dtype=bool)  # the last column is for -1
    every = np.arange(count)[:, None]
    start = np.sort(start, axis=1)[:, ::-1].copy()
    start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
    seen[every, start] = True
    wide = max(beam, start.shape[1])
    ids, dots, done = np.full((count, wide), -1, dtype=np.int32), np.full((count, wide), -2, dtype=np.float32), np.ones((count, wide), dtype=bool)
    ids[:, : start.shape[1]], dots[:, : start.shape[1]], done[:, : start.shape[1]] = start, _dots(x, q, start), start < 0
    row, col = np.nonzero(dots >= least)
    met = [(row, ids[row, col])]
    if wide > beam:
        keep = np.argpartition(-dots, beam - 1, axis=1)[:, :beam]
        ids, dots, done = (np.take_along_axis(a, keep, axis=1) for a in (ids, dots, done))
        wide = beam
    floor = np.broadcast_to(np.asarray(floor, dtype=np.float32), (count,))
    way: list[np.ndarray] = []
    on = np.arange(count)
    while len(on):
        best = np.where(done[on], np.float32(-3), dots[on]).argmax(axis=1)
        open_ = ~done[on, best]
        if len(way) >= PATIENCE:
            open_ &= dots[on, best] >= floor[on]
        on, best = on[open_], best[open_]
        if not len(on):
            break
        done[on, best] = True
        step = np.full(count, -1, dtype=np.int32)
        step[on] = ids[on, best]
        way.append(step)
        near = links[step[on]]
        near = np.where(seen[on[:, None], near], np.int32(-1), near)
        seen[on[:, None], near] = True
        fresh = _dots(x, q[on], near)
        row, col = np.nonzero(fresh >= least)
        if len(row):
            met.append((on[row], near[row, col]))
        many_ids = np.concatenate([ids[on], near], axis=1)
        many_dots = np.concatenate([dots[on], fresh], axis=1)
        many_done = np.concatenate([done[on], near < 0], axis=1)
        keep = np.argpartition(-many_dots, wide - 1, axis=1)[:, :wide] if many_dots.shape[1] > wide else np.arange(wide)[None, :]
        ids[on], dots[on], done[on] = (np.take_along_axis(a, keep, axis=1) for a in (many_ids, many_dots, many_done))
    ids[dots <= -2] = -1
    return ids, np.stack(way, axis=1) if way else np.full((count, 1), -1, dtype=np.int32), met, seen[:, :n]


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, most: int, alpha: float, beyond: np.ndarray | None = None) -> np.ndarray:
    """Up to ``most`` of each node's ``candidates`` (-1: none; repeats are dropped), the closest first.

    ``beyond``: squared distance up to which candidates of a node don't count.
    """
    out = np.full((len(nodes), most), -1, dtype=np.int32)
    wide = candidates.shape[1]
    step = max(1, GATHER_BYTES // max(1, wide * (x.shape[1] + wide) * 4))
    for lo in range(0, len(nodes), step):
        me = nodes[lo : lo + step]
        some = np.sort(candidates[lo : lo + step], axis=1)
        some[:, 1:][some[:, 1:] == some[:, :-1]] = -1
        some[some == me[:, None]] = -1
        far = 2 - 2 * _dots(x, x[me], some)
        if beyond is not None:
            some[far <= beyond[lo : lo + step, None]] = -1
            far[some < 0] = 6
        order = np.argsort(far, axis=1, kind="stable")
        some, far = np.take_along_axis(some, order, axis=1), np.take_along_axis(far, order, axis=1)
        v = x[some]
        apart = 2 - 2 * (v @ v.transpose(0, 2, 1))
        alive = some >= 0
        row = np.arange(len(me))
        for k in range(most):
            pick = alive.argmax(axis=1)
            row = row[alive[row, pick[row]]]
            if not len(row):
                break
            p = pick[row]
            out[lo + row, k] = some[row, p]
            alive[row] &= alpha * alpha * apart[row, p] > far[row]
            alive[row, p] = False
    return out


def medoids(x: np.ndarray, count: int = MEDOIDS, rounds: int = 4) -> np.ndarray:
    """Entry points: the nodes nearest to the means of ``count`` clusters."""
    middle = x[np.random.default_rng(5).permutation(len(x))[:count]].copy()
    for _ in range(rounds):
        near = (x @ middle.T).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(norm > 0, sums / np.maximum(norm, 1e-30), middle)
    return np.unique((middle @ x.T).argmax(axis=1)).astype(np.int32)


def _backwards(links: np.ndarray, nodes: np.ndarray, far: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes that ``nodes`` link to, with those that link to them, in pieces of bounded width."""
    part = links[nodes][:, NEAR:] if far else links[nodes][:, :NEAR]
    to, by = part.ravel(), np.repeat(nodes, part.shape[1])
    by, to = by[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else to[:0]
    rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
    wide = NEAR
    for lo in range(0, int(rank.max()) + 1 if len(to) else 0, wide):  # hubs in several pieces
        on = (rank >= lo) & (rank < lo + wide)
        names, at = np.unique(to[on], return_inverse=True)
        table = np.full((len(names), wide), -1, dtype=np.int32)
        table[at, rank[on] - lo] = by[on]
        yield names, table


def _reach(x: np.ndarray, links: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distance beyond which a node counts as far from each of ``nodes``."""
    near = _dots(x, x[nodes], links[nodes, :NEAR])
    return np.where(near > -2, BEYOND * (2 - 2 * near), 0).max(axis=1)


def build(x: np.ndarray) -> np.ndarray:
    """Links of the graph: n rows of ``NEAR`` + ``FAR`` nodes, -1 for none.

    Nodes enter in random order in batches no larger than what is there already; each searches the graph so far
    from its first nodes, links to what it finds and is linked back.
    """
    n = len(x)
    links = np.full((n, NEAR + FAR), -1, dtype=np.int32)
    order = np.random.default_rng(3).permutation(n).astype(np.int32)
    entry = order[:MEDOIDS]
    done = 1
    while done < n:
        new = order[done : min(n, done + max(1, min(done, TOGETHER)))]
        start = np.broadcast_to(entry[: min(done, len(entry))], (len(new), min(done, len(entry))))
        ids, way, _, _ = walk(x, links, x[new], start)
        links[new, :NEAR] = robust_prune(x, new, ids, NEAR, ALPHA)
        rest = np.concatenate([way, start, ids], axis=1)
        links[new, NEAR:] = robust_prune(x, new, rest, FAR, 1.0, _reach(x, links, new))
        for names, by in _backwards(links, new, False):
            links[names, :NEAR] = robust_prune(x, names, np.concatenate([links[names, :NEAR], by], axis=1), NEAR, ALPHA)
        for names, by in _backwards(links, new, True):
            links[names, NEAR:] = robust_prune(x, names, np.concatenate([links[names, NEAR:], by], axis=1), FAR, 1.0, _reach(x, links, names))
        done += len(new)
    return links


class Labels:
    """Connected components by smallest label, united many pairs at a time."""

    def __init__(self, count: int):
        self.of = np.arange(count)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p, q = self.of[a], self.of[b]
            apart = p != q
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            if not len(a):
                return
            up = np.arange(len(self.of))
            np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
            while (up[up] != up).any():
                up = up[up]
            self.of = up[self.of]


def range_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, own: np.ndarray, least: float, name: np.ndarray, labels: Labels, offset: int = 0) -> None:
    """Unite each query (``name`` in ``labels``) with the nodes found whose dot product is ``least`` or more.

    Node k is ``offset`` + k in ``labels``.
    Queries walk greedily from the medoids, and from their own links where they are nodes (``own``; -1: not). Then
    the range expands: links of nodes in range are followed until none leads out of the query's
    component, within which all pairs are verified anyway.
    """
    n = len(x)
    entry = medoids(x)
    near = np.cos(np.arccos(np.clip(least, -1, 1)) + REACH)  # a node's own links lead at once to what is near it
    for lo in range(0, len(q), TOGETHER):
        some, mine = q[lo : lo + TOGETHER], own[lo : lo + TOGETHER]
        start = np.broadcast_to(entry, (len(some), len(entry)))
        start = np.concatenate([start, np.where(mine[:, None] >= 0, links[mine], np.int32(-1))], axis=1)
        _, _, met, seen = walk(x, links, some, start, least, floor=np.where(mine >= 0, near, -2.0))
        row, node = np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met]).astype(np.int64)
        me = name[lo : lo + TOGETHER]
        while len(row):
            labels.unite(me[row], offset + node)
            to = links[node]
            row, to = np.repeat(row, to.shape[1]), to.ravel().astype(np.int64)
            on = to >= 0
            row, to = row[on], to[on]
            on = ~seen[row, to] & (labels.of[offset + to] != labels.of[me[row]])
            pair = np.unique(row[on] * n + to[on])
            row, node = pair // n, pair % n
            seen[row, node] = True
            good = np.zeros(len(row), dtype=bool)
            step = max(1, GATHER_BYTES // (8 * x.shape[1]))
            for k in range(0, len(row), step):
                good[k : k + step] = np.einsum("kd,kd->k", some[row[k : k + step]], x[node[k : k + step]]) >= least
            row, node = row[good], node[good]
