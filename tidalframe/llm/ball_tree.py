"""Ball trees over integer vectors, searched by branch and bound for the highest inner products in a window.

A node is a run of rows with a centre, a radius and the least and largest label below it. For a query q, every row of a node
scores between q.c - |q| r and q.c + |q| r. A node is left out for a query if it lies outside of the query's score window,
strictly beneath its k-th best score so far, or has no row of a fitting label; ties with the k-th score are looked at,
as the smaller id wins. Nodes of several labels are divided by label first, so that most nodes below have one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 128
NONE = np.iinfo(np.int64).min
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)


@dataclass
class Tree:
    """Rows in tree order, and nodes: node 0 is the root, ``left`` and ``right`` are -1 at leaves."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    least: np.ndarray
    most: np.ndarray
    radius: np.ndarray
    centre: np.ndarray


def _halves(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, int]:
    """An order of the rows and where to cut it: between labels, else across the line between two far rows."""
    if labels.min() != labels.max():
        order = np.argsort(labels, kind="stable")
        edges = np.flatnonzero(np.diff(labels[order])) + 1
        return order, int(edges[np.argmin(np.abs(edges - len(rows) // 2))])
    far = rows[np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))]
    other = rows[np.argmax(((rows - far) ** 2).sum(axis=1))]
    return np.argsort(rows @ (other - far), kind="stable"), len(rows) // 2


@np.errstate(over="ignore", invalid="ignore")
def build(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over doubles that hold integers; rows, ids and labels go along."""
    order = np.arange(len(rows))
    lo, hi, left, right = [0], [len(rows)], [-1], [-1]
    todo = [0]
    while todo:
        node = todo.pop()
        a, b = lo[node], hi[node]
        if b - a <= leaf:
            continue
        by, cut = _halves(rows[order[a:b]], labels[order[a:b]])
        order[a:b] = order[a:b][by]
        for side, (x, y) in ((left, (a, a + cut)), (right, (a + cut, b))):
            side[node] = len(lo)
            todo.append(len(lo))
            lo.append(x)
            hi.append(y)
            left.append(-1)
            right.append(-1)
    ids, labels, rows = ids[order], labels[order], rows[order]
    runs = list(zip(lo, hi, strict=True))
    centre = np.stack([rows[a:b].mean(axis=0) for a, b in runs])
    radius = np.array([np.sqrt(((rows[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(runs, centre, strict=True)])
    least, most = (np.array([of(labels[a:b]) for a, b in runs]) for of in (np.min, np.max))
    return Tree(ids, labels, rows, np.array(lo), np.array(hi), np.array(left), np.array(right), least, most, radius, centre)


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; those beyond a long count as its ends."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if most < EXACT:
        return np.rint(left @ right.T).astype(np.int64)
    whole = lambda x: np.array([[int(c) for c in r] for r in x.tolist()], dtype=object).reshape(x.shape)
    out = whole(left) @ whole(right).T
    ends = np.iinfo(np.int64)
    return np.array([[min(max(int(s), ends.min + 1), ends.max) for s in r] for r in out], dtype=np.int64).reshape(len(left), len(right))


class Search:
    """The best ``k`` rows of each query over any number of trees.

    Query i asks for rows whose score with anchor ``of[i]`` lies in [lo[i], hi[i]] and whose label is (``same``) or is not the
    anchor's; rows that bear the anchor's own id don't count.
    """

    def __init__(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool):
        self.anchors, self.ids, self.labels, self.of, self.lo, self.hi, self.k, self.same = anchors, ids, labels, of, lo, hi, k, same
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((anchors**2).sum(axis=1))
        self.score = np.full((len(of), k), NONE)
        self.found = np.zeros((len(of), k), dtype=np.int64)
        self.count = np.zeros(len(of), dtype=np.int64)
        self.looked = 0

    def _floor(self, some: np.ndarray) -> np.ndarray:
        """The least score that still counts."""
        return np.maximum(self.lo[some], self.score[some, -1])

    @np.errstate(over="ignore", invalid="ignore")
    def _open(self, tree: Tree, node: int, some: np.ndarray) -> tuple[np.ndarray, float]:
        """The queries of ``some`` for which a node may hold a row, and how high it may score for them."""
        mine = self.labels[self.of[some]]
        pure = tree.least[node] == tree.most[node]
        fits = (tree.least[node] <= mine) & (mine <= tree.most[node]) if self.same else ~(pure & (mine == tree.least[node]))
        some = some[fits]
        asked, back = np.unique(self.of[some], return_inverse=True)
        middle = self.anchors[asked] @ tree.centre[node]
        reach = self.norm[asked] * tree.radius[node]
        reach = reach + 1e-9 * (np.abs(middle) + reach + self.norm[asked] * np.sqrt((tree.centre[node] ** 2).sum())) + 1
        top, low = (middle + reach)[back], (middle - reach)[back]
        stays = ~(top < self._floor(some)) & ~(low > self.hi[some])  # bounds that aren't numbers leave nothing out
        return some[stays], float(np.nan_to_num(np.minimum(top, self.hi[some])[stays]).sum())

    def visit(self, tree: Tree) -> None:
        every, _ = self._open(tree, 0, np.flatnonzero(self.lo <= self.hi))
        todo = [(0, every)]
        while todo:
            node, some = todo.pop()
            if node:  # scores may have risen since
                some, _ = self._open(tree, node, some)
            if not len(some):
                continue
            if tree.left[node] < 0:
                self._score(tree, node, some)
                continue
            sides = [(*self._open(tree, int(child), some), int(child)) for child in (tree.left[node], tree.right[node])]
            todo += [(child, open_) for open_, _, child in sorted(sides, key=lambda s: s[1])]  # the better side is looked at first

    def _score(self, tree: Tree, node: int, some: np.ndarray) -> None:
        run = slice(tree.lo[node], tree.hi[node])
        asked, back = np.unique(self.of[some], return_inverse=True)
        got = scores(self.anchors[asked], tree.rows[run])
        alike = self.labels[asked, None] == tree.labels[None, run]
        fits = (alike if self.same else ~alike) & (self.ids[asked, None] != tree.ids[None, run])
        self.looked += got.size
        got = got[back]
        query, at = np.nonzero(fits[back] & (got >= self._floor(some)[:, None]) & (got <= self.hi[some][:, None]))
        if len(query):
            self._keep(some[query], got[query, at], tree.ids[run][at])

    def _keep(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Let the best ``k`` of old and new rows stay."""
        those = np.unique(query)
        old = np.repeat(those, self.count[those])
        place = np.arange(len(old)) - np.repeat(np.cumsum(self.count[those]) - self.count[those], self.count[those])
        query, score, ids = (np.concatenate(p) for p in ((query, old), (score, self.score[old, place]), (ids, self.found[old, place])))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(first, np.diff([*first, len(query)]))
        best = place < self.k
        query, place = query[best], place[best]
        self.score[query, place], self.found[query, place] = score[best], ids[best]
        self.count[those] = np.bincount(np.searchsorted(those, query), minlength=len(those))

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of all rows found."""
        query = np.repeat(np.arange(len(self.of)), self.count)
        place = np.arange(len(query)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        return query, self.score[query, place], self.found[query, place]
