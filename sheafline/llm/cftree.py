"""A cluster-feature tree: vectors are inserted in blocks, nearest child by nearest child.

Every node keeps count and sum of what lies below each child, which give the
child's centroid. A vector that comes to a leaf node is absorbed by the nearest
entry whose first vector lies within the threshold, else it begins an entry of
its own; a node of more than ``branching`` children is split where they spread
widest. The number of entries is bounded: a full tree is closed and the next one
begins, as trees are merged afterwards anyway.
"""

from __future__ import annotations

import numpy as np


class CFTree:
    """``insert`` returns for each row the first vector of the entry that took it."""

    def __init__(self, threshold: float, branching: int = 32, most: int = 50_000):
        self.threshold, self.branching, self.most = threshold, branching, most
        self.root, self.entries = None, 0

    def insert(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        if not len(x):
            return out
        if self.root is None or self.entries > self.most:
            self.root, self.entries = _Leaf(x.shape[1]), 0
        nodes = self._put(self.root, x, np.arange(len(x)), out)
        while len(nodes) > 1:
            nodes = _inner(nodes, self.branching)
        self.root = nodes[0]
        return out

    def _put(self, node, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> list:
        """Insert ``rows`` below a node; the nodes that take its place."""
        if isinstance(node, _Leaf):
            return self._absorb(node, x, rows, out)
        at = _nearest(x[rows], node.total / node.count[:, None])[0]
        kids, changed = [], np.bincount(at, minlength=len(node.kids))
        for j, kid in enumerate(node.kids):
            kids += self._put(kid, x, rows[at == j], out) if changed[j] else [kid]
        return _inner(kids, self.branching)

    def _absorb(self, leaf: _Leaf, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> list:
        if len(leaf.first):
            at, gap = _nearest(x[rows], leaf.first)
            near = gap <= self.threshold
            leaf.add(at[near], x[rows[near]])
            out[rows[near]] = leaf.first[at[near]]
            rows = rows[~near]
        if not len(rows):
            return [leaf]
        leaves = [leaf] if len(leaf.first) else []
        for part in _halved(x[rows], 4 * self.branching):
            leaves.append(self._begin(x, rows[part], out))
        return [piece for one in leaves for piece in one.split(self.branching)]

    def _begin(self, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> _Leaf:
        """A new leaf node of few vectors."""
        points, left = x[rows], np.arange(len(rows))
        taken = np.empty(len(rows), np.int64)
        first = []
        while len(left):
            gap = np.sqrt(((points[left] - points[left[0]]) ** 2).sum(1))
            near = gap <= self.threshold
            taken[left[near]] = len(first)
            first.append(points[left[0]])
            left = left[~near]
        node = _Leaf(x.shape[1])
        node.first = np.array(first)
        node.count, node.total = np.zeros(len(first)), np.zeros_like(node.first)
        node.add(taken, points)
        out[rows] = node.first[taken]
        self.entries += len(first)
        return node


class _Leaf:
    def __init__(self, width: int):
        self.first, self.count, self.total = np.zeros((0, width)), np.zeros(0), np.zeros((0, width))

    def add(self, at: np.ndarray, points: np.ndarray) -> None:
        np.add.at(self.count, at, 1)
        np.add.at(self.total, at, points)

    def split(self, most: int) -> list[_Leaf]:
        if len(self.first) <= most:
            return [self]
        out = []
        for part in _halved(self.first, most):
            node = _Leaf(self.first.shape[1])
            node.first, node.count, node.total = self.first[part], self.count[part], self.total[part]
            out.append(node)
        return out


class _Inner:
    def __init__(self, kids: list):
        self.kids = kids
        self.count = np.array([k.count.sum() for k in kids])
        self.total = np.array([k.total.sum(0) for k in kids])


def _inner(kids: list, most: int) -> list:
    """Nodes of at most ``most`` children each over these."""
    if len(kids) == 1:
        return kids
    if len(kids) <= most:
        return [_Inner(kids)]
    centres = np.array([k.total.sum(0) / k.count.sum() for k in kids])
    return [_Inner([kids[i] for i in part]) for part in _halved(centres, most)]


def _halved(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Parts of at most ``most`` rows, halved where they spread widest."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(x[rows], axis=0)))
        half = len(rows) // 2
        order = np.argpartition(x[rows, axis], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its distance."""
    at, gap = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), 8192):
        d = np.zeros((len(x[i : i + 8192]), len(centres)))
        for c in range(x.shape[1]):
            d += (x[i : i + 8192, c, None] - centres[None, :, c]) ** 2
        at[i : i + 8192] = d.argmin(1)
        gap[i : i + 8192] = np.sqrt(d.min(1))
    return at, gap
