"""The largest sets of mutually similar vectors, best first and vertex by vertex.

A maximal set belongs to its member of the smallest id, its owner, and lies
within the radius around it. So each owner's best set is found among its
neighbours alone, by branch and bound, and owners wait in a heap by what they
have at most: only what comes up is searched. Nothing is listed or cut off.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np

#: Vectors up to which every pair gets its bit; more are looked up by cells.
BIT_ROWS = 4_096


def best_first(x: np.ndarray, n: np.ndarray, vid: np.ndarray, radius: float, min_size: int, home=None, free=None) -> np.ndarray:
    """Per vector the smallest id of the set chosen for it, or NONE.

    A set is one of vectors within ``radius`` of each other to which no further
    one can be added, with at least ``min_size`` records (``n`` of each vector).
    Of overlapping ones the larger is chosen, of equal ones that with the
    smallest id that the other lacks. Vectors that are not ``free`` belong to
    sets chosen before. Where ``home`` is given, only sets owned by those
    vectors are chosen, and only if no set that could come before them and
    overlap them belongs to another owner that is not settled here. Then all
    vectors within three radii of those of ``home`` are to be there.
    """
    m = len(x)
    out = np.full(m, NONE, np.int64)
    order = np.argsort(vid, kind="stable")
    x, n, vid = x[order], n[order].astype(np.int64), vid[order]
    taken = np.zeros(m, bool) if free is None else ~free[order]
    mine = np.ones(m, bool) if home is None else home[order]
    near = _Near(x, radius)
    stopped = np.zeros(m, bool)  # an unsettled set that comes before may overlap theirs
    if home is not None:  # owners farther off lack neighbours here and settle nothing
        reach = _Near(x[mine], 2 * radius, np.flatnonzero(mine))
        known = np.array([mine[v] or len(reach.of(x[v])) > 0 for v in range(m)], bool)
    else:
        known = np.ones(m, bool)
    wide = _Near(x, 2 * radius) if home is not None else None
    bounds, sets = [], []  # owners by the most their best set can weigh, and best sets found
    for v in np.flatnonzero(~taken & known):
        around = near.of(x[v])
        most = int(n[around[(around >= v) & ~taken[around]]].sum())
        if most >= min_size:
            bounds.append((-most, int(v)))
    heapq.heapify(bounds)
    while True:
        while sets and (taken[sets[0][1]] or _spoilt(sets[0][2], near.of(x[sets[0][1]]), x, taken, radius)):
            size, v, _ = heapq.heappop(sets)
            if not taken[v]:
                heapq.heappush(bounds, (size, v))
        while bounds and (not sets or bounds[0] < sets[0][:2]):
            _, v = heapq.heappop(bounds)
            if taken[v]:
                continue
            # nothing that comes after the best set at hand need be found now
            least = max(min_size, -sets[0][0] + (sets[0][1] < v)) if sets else min_size
            weight, found = _owned(v, near.of(x[v]), x, n, taken, radius, least)
            if found is not None:
                heapq.heappush(sets, (-weight, v, found))
            elif least > min_size:
                heapq.heappush(bounds, (1 - least, v))
        if not sets:
            return out
        _, v, found = heapq.heappop(sets)
        if mine[v] and not stopped[v]:
            taken[found] = True
            out[order[found]] = vid[found[0]]
        elif wide is not None:
            stopped[wide.of(x[v])] = True


def _spoilt(found: np.ndarray, around: np.ndarray, x: np.ndarray, taken: np.ndarray, radius: float) -> bool:
    """Whether a set has lost members, or a vector that is taken now would extend it."""
    if taken[found].any():
        return True
    others = around[taken[around]]
    return bool(_pairs(x[others], x[found], radius).all(1).any())


NONE = -(2**63)


class _Near:
    """The vectors within the radius of a point, by cells of that side."""

    def __init__(self, x: np.ndarray, radius: float, names: np.ndarray | None = None):
        self.x, self.radius, self.names = x, radius, np.arange(len(x)) if names is None else names
        self.axes = min(4, x.shape[1])
        self.bits = None
        self.cells: dict[tuple, np.ndarray] = {}
        if len(x):
            self.side = radius * (1 + 1e-9)
            keys = np.floor(x[:, : self.axes] / self.side)
            _, flat = np.unique(keys, axis=0, return_inverse=True)
            flat = flat.ravel()
            order = np.argsort(flat, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1):
                self.cells[tuple(keys[rows[0]])] = rows
        self.steps = list(itertools.product((-1.0, 0.0, 1.0), repeat=self.axes))
        self.around: dict[tuple, np.ndarray] = {}

    def of(self, point: np.ndarray) -> np.ndarray:
        """Their names, ascending."""
        if not self.cells:
            return np.zeros(0, np.int64)
        key = tuple(np.floor(point[: self.axes] / self.side))
        rows = self.around.get(key)
        if rows is None:
            parts = [self.cells[k] for s in self.steps if (k := tuple(a + b for a, b in zip(key, s))) in self.cells]
            rows = self.around[key] = np.sort(np.concatenate([*parts, np.zeros(0, np.int64)]))
        return self.names[rows[_gap(self.x[rows], point) <= self.radius]]


def _gap(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x))
    for c in range(x.shape[1]):
        s += (x[:, c] - point[c]) ** 2
    return np.sqrt(s)


def _pairs(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    s = np.zeros((len(a), len(b)))
    for c in range(a.shape[1]):
        s += (a[:, c, None] - b[None, :, c]) ** 2
    return np.sqrt(s) <= radius


def _owned(v: int, around: np.ndarray, x: np.ndarray, n: np.ndarray, taken: np.ndarray, radius: float, min_size: int):
    """(size, members) of the best set whose smallest member is ``v``, or (0, None)."""
    # a set that a smaller free vector extends is lighter than that one's best set and comes up after it
    p, out = around[(around > v) & ~taken[around]], around[taken[around]]
    if n[v] + n[p].sum() < min_size:
        return 0, None
    inner, outer = _pairs(x[p], x[p], radius), _pairs(x[out], x[p], radius)
    # members that the same vectors are close to come together or not at all
    rows = np.packbits(np.concatenate([inner, outer.T], axis=1), axis=1)
    view = np.ascontiguousarray(rows).view(np.dtype((np.void, max(1, rows.shape[1])))).ravel() if len(p) else np.zeros(0)
    _, first, twin = np.unique(view, return_index=True, return_inverse=True)
    rank = np.argsort(first, kind="stable")  # by the smallest id of each
    first, twin = first[rank], np.argsort(rank, kind="stable")[twin.ravel()]
    k = len(first)
    weight = np.bincount(twin, n[p], k).astype(np.int64).tolist()
    links = [_mask(r) & ~(1 << i) for i, r in enumerate(inner[np.ix_(first, first)])]
    barred = list({_mask(r) for r in outer[:, first]})
    mask = heaviest(links, weight, barred, int(n[v]), min_size)
    if mask is None:
        return 0, None
    members = np.array([bool(mask >> int(t) & 1) for t in twin], bool)
    return int(n[v] + n[p[members]].sum()), np.concatenate([[v], p[members]]).astype(np.int64)


def _mask(row: np.ndarray) -> int:
    return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")


def heaviest(links: list[int], weight: list[int], barred: list[int], start: int, min_size: int) -> int | None:
    """Of the maximal cliques that no ``barred`` vertex (given by its links) extends
    the heaviest, at equal weight that with the lowest bit the other lacks; None
    if none weighs ``min_size`` with ``start``."""
    best, most = None, min_size

    def better(mask: int, size: int) -> bool:
        if best is None:
            return size >= most
        differ = mask ^ best
        return size > most or size == most and bool(mask & (differ & -differ))

    everything = (1 << len(links)) - 1
    stack = [(0, everything, 0, barred, start)]
    while stack:
        r, p, x, bars, size = stack.pop()
        if any(not p & ~b for b in bars):  # what is close to all that is left extends every clique from here
            continue
        if not p:
            if not x and better(r, size):
                best, most = r, size
            continue
        rest, closed = x, False
        while rest and not closed:
            bit = rest & -rest
            rest ^= bit
            closed = not p & ~links[bit.bit_length() - 1]
        if closed:
            continue
        # vertices of one colour exclude each other, so the heaviest of each colour bound the weight
        bounds, left, bound = [], p, size
        while left:
            free, top, colour = left, 0, []
            while free:
                bit = free & -free
                u = bit.bit_length() - 1
                free &= ~(bit | links[u])
                left ^= bit
                top = max(top, weight[u])
                colour.append(u)
            bound += top
            bounds += [(bound, u) for u in colour]
        branches = []
        for bound, u in reversed(bounds):  # vertices before this one weigh no more than bound
            if bound < most or best is not None and not better(r | p, bound):
                break
            bit = 1 << u
            branches.append((r | bit, p & links[u], x & links[u], [b for b in bars if b >> u & 1], size + weight[u]))
            p ^= bit
            x |= bit
        stack += reversed(branches)
    return best
