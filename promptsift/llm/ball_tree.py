"""Ball trees over integer vectors, and branch-and-bound search by inner product within windows.

A tree halves its rows along the widest dimension until a leaf holds LEAF of them. Each node
has a centre and a radius, which bound the inner product of a query with its rows from both
sides: q·c ± |q| r. It also has its least id, and which labels it holds.

A search wants the k best rows of those whose score lies in the query's window: higher scores
first, ties by smaller id. It first follows the more promising child down to a leaf, then goes
through the levels and drops nodes that lie outside the window, that have no row of a wanted
label, or that lie strictly beneath the k-th row found (with ties: whose ids are all greater).
What is left is visited leaf by leaf, those with the best bounds first, each with all queries for which it still matters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 64
#: Bounds are floating point: they are widened by this share of the lengths that went into them.
SLACK = 1e-9
NO_ID = np.iinfo(np.int64).max
NO_SCORE = -NO_ID


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, int64."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


@dataclass
class Tree:
    """Rows in the leaves' order; node k has the children 2 k + 1 and 2 k + 2, the last level are leaves."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    least_ids: np.ndarray
    has: np.ndarray
    kinds: np.ndarray
    depth: int


def grown(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
    depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
    count = (1 << depth + 1) - 1
    starts, stops = np.zeros(count, np.int64), np.zeros(count, np.int64)
    stops[0] = len(ids)
    order = np.argsort(ids, kind="stable")
    real = vectors.astype(np.float64)
    for node in range(count):
        a, b = starts[node], stops[node]
        if 2 * node + 1 >= count:
            continue
        if b > a:
            own = real[order[a:b]]
            widest = int(np.argmax(own.max(0) - own.min(0))) if own.shape[1] else 0
            if own.shape[1]:
                order[a:b] = order[a:b][np.argsort(own[:, widest], kind="stable")]
        middle = (a + b) // 2
        starts[2 * node + 1], stops[2 * node + 1] = a, middle
        starts[2 * node + 2], stops[2 * node + 2] = middle, b
    kinds = np.unique(labels)
    rows, ids, labels, vectors, real = rows[order], ids[order], labels[order], vectors[order], real[order]
    of = np.searchsorted(kinds, labels)
    d = vectors.shape[1]
    centres, radii, least, has = np.zeros((count, d)), np.zeros(count), np.full(count, NO_ID), np.zeros((count, len(kinds)), bool)
    for node in range(count):
        a, b = starts[node], stops[node]
        if b > a:
            centres[node] = real[a:b].mean(0)
            radii[node] = np.sqrt(((real[a:b] - centres[node]) ** 2).sum(1).max())
            least[node] = ids[a:b].min()
            has[node, of[a:b]] = True
    return Tree(rows, ids, labels, vectors, starts, stops, centres, radii, least, has, kinds, depth)


@dataclass
class Wanted:
    """Queries: vectors, the label that rows must have (same) or must not have, windows of scores, and the row of their own, which is left out."""

    vectors: np.ndarray
    labels: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray
    own: np.ndarray
    k: int


@dataclass
class Best:
    """The k best rows so far, best first; those not found have the id NO_ID."""

    scores: np.ndarray
    ids: np.ndarray
    visited: int = 0

    @staticmethod
    def none(n: int, k: int) -> Best:
        return Best(np.full((n, k), NO_SCORE), np.full((n, k), NO_ID))

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores, ids: candidates of the queries at, as rows; NO_ID: none, whose score is the least."""
        k = self.ids.shape[1]
        matters = (scores.max(1, initial=NO_SCORE) >= self.scores[at, -1]) & (ids != NO_ID).any(1)
        at, scores, ids = at[matters], scores[matters], ids[matters]
        if not len(at):
            return
        if scores.shape[1] > k:  # only what can be among the k best, ties kept
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            keep = int((scores >= kth).sum(1).max())
            if keep < scores.shape[1]:
                pick = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                scores, ids = np.take_along_axis(scores, pick, 1), np.take_along_axis(ids, pick, 1)
        scores, ids = np.append(self.scores[at], scores, 1), np.append(self.ids[at], ids, 1)
        by = np.lexsort((ids, -scores), axis=1)[:, :k]
        self.scores[at], self.ids[at] = np.take_along_axis(scores, by, 1), np.take_along_axis(ids, by, 1)


def _bounds(tree: Tree, want: Wanted, lengths: np.ndarray, queries: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above, for pairs of queries and nodes."""
    some, of = np.unique(nodes, return_inverse=True)
    middle = (want.vectors.astype(np.float64) @ tree.centres[some].T)[queries, of]
    reach = lengths[queries] * (tree.radii[nodes] + SLACK * (1 + np.sqrt((tree.centres[nodes] ** 2).sum(1)) + tree.radii[nodes])) + SLACK
    return middle - reach, middle + reach


def _open(tree: Tree, want: Wanted, best: Best, queries: np.ndarray, nodes: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Which pairs may still hold a wanted row that would be among the best."""
    kind = np.searchsorted(tree.kinds, want.labels[queries])
    known = (kind < len(tree.kinds)) & (tree.kinds[np.minimum(kind, len(tree.kinds) - 1)] == want.labels[queries])
    own = known & tree.has[nodes, np.minimum(kind, len(tree.kinds) - 1)]
    some = own if want.same else tree.has[nodes].sum(1) > own
    kth, kth_id = best.scores[queries, -1], best.ids[queries, -1]
    better = (kth_id == NO_ID) | (above > kth) | ((above >= kth) & (tree.least_ids[nodes] < kth_id))
    return some & (above >= want.low[queries]) & (below <= want.high[queries]) & better


def _visit(tree: Tree, want: Wanted, best: Best, at: np.ndarray, node: int) -> None:
    """Scores the rows of a leaf with queries."""
    rows = slice(tree.starts[node], tree.stops[node])
    scores = dots(want.vectors[at], tree.vectors[rows])
    same = tree.labels[rows][None, :] == want.labels[at][:, None]
    good = (same == want.same) & (scores >= want.low[at][:, None]) & (scores <= want.high[at][:, None]) & (tree.rows[rows][None, :] != want.own[at][:, None])
    best.visited += good.size
    best.add(at, np.where(good, scores, NO_SCORE), np.where(good, tree.ids[rows][None, :], NO_ID))


def searched(tree: Tree, want: Wanted) -> Best:
    """The k best wanted rows of a tree for each query."""
    n = len(want.vectors)
    best = Best.none(n, want.k)
    if not n or not len(tree.ids):
        return best
    lengths = np.sqrt((want.vectors.astype(np.float64) ** 2).sum(1))
    every, first = np.arange(n), np.zeros(n, np.int64)
    for _ in range(tree.depth):
        left, right = (_bounds(tree, want, lengths, every, 2 * first + side)[1] for side in (1, 2))
        first = 2 * first + 1 + (right > left)
    for node in np.unique(first):
        _visit(tree, want, best, every[first == node], node)
    queries, nodes = every, np.zeros(n, np.int64)
    below, above = _bounds(tree, want, lengths, queries, nodes)
    for level in range(tree.depth + 1):
        going = _open(tree, want, best, queries, nodes, below, above)
        queries, nodes, below, above = queries[going], nodes[going], below[going], above[going]
        if level < tree.depth:
            queries, nodes = np.repeat(queries, 2), np.repeat(2 * nodes + 1, 2)
            nodes[1::2] += 1
            below, above = _bounds(tree, want, lengths, queries, nodes)
    fresh = nodes != first[queries]
    queries, nodes, below, above = queries[fresh], nodes[fresh], below[fresh], above[fresh]
    by = np.argsort(nodes, kind="stable")
    leaves, at = np.unique(nodes[by], return_index=True)
    parts = np.split(by, at[1:]) if len(leaves) else []
    for k in np.argsort([-above[p].max() for p in parts]) if parts else ():
        part = parts[k]
        part = part[_open(tree, want, best, queries[part], nodes[part], below[part], above[part])]
        if len(part):
            _visit(tree, want, best, queries[part], leaves[k])
    return best
