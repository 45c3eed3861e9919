"""Degrees and least-weight paths under conditions on nodes and edges."""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..relation import GraphModel
from ..runtime import BROADCAST_ROWS, cut

#: Admitted edges up to which a path is searched on the driver (28 bytes each),
#: and the rounds after which a heap takes over there.
LOCAL_EDGES, MOST_ROUNDS = 2_000_000, 5_000
#: Assignments of attributes to conditions one search may try.
MOST_ASSIGNMENTS = 4_096


@dataclass(frozen=True)
class Condition:
    """``attribute`` of all nodes (or edges) of the path is ``value``, or the same
    truth value throughout if that is None; attribute None means any one of them."""

    on_nodes: bool
    attribute: str | None
    value: int | None = None


@dataclass(frozen=True)
class Path:
    """``nodes`` in path order; ``edges`` as (src, dst, weight) in path order."""

    weight: int
    nodes: list[int]
    edges: list[tuple[int, int, int]]


def degrees(g: GraphModel) -> DataFrame:
    """(node, degree) for every node: incident edges, a self-loop counts twice.

    Edge ends that are no node are not reported; nodes without edges have 0.
    """
    nodes, edges = g.nodes, g.edges
    src, dst = (F.col(edges.fields[i].physical).cast("long") for i in (0, 1))
    ends = edges.df.select(F.explode(F.array(src, dst)).alias("__n")).where("__n is not null")
    counts = ends.groupBy("__n").agg(F.count("*").alias("__d"))
    ids = nodes.df.select(F.col(nodes.fields[0].physical).cast("long").alias("node")).where("node is not null").distinct()
    return ids.join(counts, F.col("node") == F.col("__n"), "left").select("node", F.coalesce("__d", F.lit(0)).cast("long").alias("degree"))


def degree(g: GraphModel, node: int) -> int | None:
    """Degree of one node, or None if there is no such node."""
    if not has_node(g, node):
        return None
    src, dst = (F.col(g.edges.fields[i].physical) for i in (0, 1))
    hits = g.edges.df.where((src == node) | (dst == node))
    return hits.agg(F.sum((src == node).cast("int") + (dst == node).cast("int"))).first()[0] or 0 if not hits.isEmpty() else 0


def has_node(g: GraphModel, node: int) -> bool:
    return not g.nodes.df.where(F.col(g.nodes.fields[0].physical) == node).isEmpty()


def shortest_path(g: GraphModel, start: int, end: int, conditions: list[Condition] = (), local_edges: int = LOCAL_EDGES) -> Path | None:
    """The least-weight path whose nodes and edges satisfy all conditions.

    Of equal weights that with fewer edges. Conditions that leave an attribute
    or a value open are tried with every choice and the least weight of all
    holds; an unknown attribute satisfies nothing. The caller sees to it that
    both nodes exist. A path from a node to itself weighs 0. Edges with a null
    end, a null weight or an end that is no node are not used. Negative
    weights raise ValueError. Few admitted edges (counted) are searched on the
    driver; otherwise distances spread by joins, one round per step of the
    path, with all choices side by side.
    """
    choices = _assignments(g, start, end, list(conditions))
    if not choices:
        return None
    if start == end:
        return Path(0, [start], [])
    nodes, edges = g.plain()
    edges = edges.where("src is not null and dst is not null and weight is not null")
    if not edges.where("weight < 0").isEmpty():
        raise ValueError("negative weights")
    tests_n = [_all(f"n_{i} = {v}" for i, v in a[0]) for a in choices]
    tests_e = [_all(f"e_{i} = {v}" for i, v in a[1]) for a in choices]
    ok_nodes = nodes.where("id is not null").select("id", _tags(tests_n).alias("aids")).where("size(aids) > 0")
    ok_nodes = ok_nodes.select("id", F.explode("aids").alias("aid")).distinct()
    tagged = edges.select("src", "dst", "weight", F.explode(_tags(tests_e)).alias("aid"))
    least = tagged.groupBy("aid", "src", "dst").agg(F.min("weight").alias("weight"))
    ends = ok_nodes.withColumnRenamed("aid", "__a")
    for c in ("src", "dst"):
        least = least.join(ends.withColumnRenamed("id", f"__{c}"), (F.col(c) == F.col(f"__{c}")) & (F.col("aid") == F.col("__a")), "left_semi")
    least = cut(least)
    if least.count() <= local_edges:
        return _local(least.toArrow().to_pandas(), start, end)
    return _spread(least, start, end, len(choices))


def _all(tests) -> str:
    return " and ".join(tests) or "true"


def _tags(tests: list[str]):
    return F.filter(F.array(*[F.when(F.expr(t), F.lit(i)) for i, t in enumerate(tests)]), lambda x: x.isNotNull())


def _assignments(g: GraphModel, start: int, end: int, conditions: list[Condition]) -> list[tuple[tuple, tuple]]:
    """The choices as (node tests, edge tests), each a tuple of (attribute index, value).

    Start and end lie on the path, so a node attribute can only be uniform
    with the value both have, which leaves no choice of value for nodes.
    """
    n = g.nodes
    at = F.col(n.fields[0].physical).cast("long")
    row = F.struct(*[F.col(f.physical) for f in n.fields[1:]], F.lit(0).alias("_"))
    # of repeated rows of a node the smallest holds
    ends = n.df.agg(*[F.min(F.when(at == v, row)) for v in (start, end)]).first() if conditions else (None, None)
    rows = {v: tuple(r)[:-1] for v, r in zip((start, end), ends) if r is not None}
    options = []
    for c in conditions:
        names = g.node_attributes if c.on_nodes else g.edge_attributes
        at = range(len(names)) if c.attribute is None else [names.index(c.attribute)] if c.attribute in names else []
        if c.on_nodes:
            a, b = rows.get(start), rows.get(end)
            fits = [(True, i, a[i]) for i in at if a and b and a[i] is not None and a[i] == b[i] and (a[i] == c.value if c.value is not None else a[i] in (0, 1))]
        else:
            fits = [(False, i, v) for i in at for v in ([c.value] if c.value is not None else [0, 1])]
        options.append(fits)
    out = {((), ()): None}
    for fits in options:  # condition by condition, so that equal choices are one before the next
        merged = {}
        for (nodes, edges), (on, i, v) in itertools.product(out, fits):
            pick = {(i, v)}
            merged[(tuple(sorted({*nodes, *pick})), edges) if on else (nodes, tuple(sorted({*edges, *pick})))] = None
            if len(merged) > MOST_ASSIGNMENTS:
                raise ValueError("too many combinations of attributes")
        out = merged
    # a choice that demands less than another one includes it
    sets = [(set(a), set(b)) for a, b in out]
    return [k for k, (a, b) in zip(out, sets) if not any((x <= a and y <= b) and (x, y) != (a, b) for x, y in sets)]


def _local(edges, start: int, end: int) -> Path | None:
    best = None
    for _, part in edges.groupby("aid", sort=True):
        found = _search(part["src"].to_numpy(), part["dst"].to_numpy(), part["weight"].to_numpy(), start, end)
        if found and (best is None or (found.weight, len(found.edges)) < (best.weight, len(best.edges))):
            best = found
    return best


def _search(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, start: int, end: int) -> Path | None:
    """Relax whole frontiers at once; (weight, edges) of a path are one number.

    Paths of very many edges, or weights too large for that number, go to a heap.
    """
    names, flat = np.unique(np.concatenate([[start, end], src, dst]), return_inverse=True)
    n = len(names)
    s, t, u, v = int(flat[0]), int(flat[1]), flat[2 : 2 + len(src)], flat[2 + len(src) :]
    if len(weight) and int(weight.max()) * (n + 1) * (n + 1) >= 2**62:
        return _dijkstra(src, dst, weight, start, end)
    order = np.argsort(u, kind="stable")
    u, v, cost = u[order], v[order], weight[order].astype(np.int64) * (n + 1) + 1
    first = np.searchsorted(u, np.arange(n + 1))
    label = np.full(n, 2**62, np.int64)
    label[s] = 0
    front = np.array([s])
    for _ in range(MOST_ROUNDS):
        counts = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        new = np.repeat(label[front], counts) + cost[at]
        good = new < np.minimum(label[v[at]], label[t])
        at, new = v[at][good], new[good]
        if not len(at):
            break
        np.minimum.at(label, at, new)
        front = np.unique(at)
    else:
        return _dijkstra(src, dst, weight, start, end)
    if label[t] >= 2**62:
        return None

    def before(node: int):  # of the neighbours that fit the smallest
        x = int(np.searchsorted(names, node))
        fits = np.flatnonzero((v == x) & (label[u] + cost == label[x]))
        e = fits[np.argmin(u[fits])]
        return names[u[e]], cost[e] // (n + 1)

    return _walk(before, start, end)


def _dijkstra(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, start: int, end: int) -> Path | None:
    order = np.lexsort((dst, src))
    src, dst, weight = src[order], dst[order], weight[order]
    done: dict[int, tuple] = {}
    heap = [(0, 0, start, start, 0)]
    while heap:
        d, hops, prev, node, w = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = (prev, w)
        if node == end:
            break
        lo, hi = np.searchsorted(src, [node, node + 1])
        for v, x in zip(dst[lo:hi].tolist(), weight[lo:hi].tolist()):
            if v not in done:
                heapq.heappush(heap, (d + x, hops + 1, node, v, x))
    if end not in done:
        return None
    return _walk(lambda v: done[v], start, end)


def _walk(before, start: int, end: int) -> Path:
    nodes, edges = [end], []
    while nodes[-1] != start:
        prev, w = before(nodes[-1])
        edges.append((int(prev), int(nodes[-1]), int(w)))
        nodes.append(int(prev))
    return Path(sum(e[2] for e in edges), nodes[::-1], edges[::-1])


def _spread(edges: DataFrame, start: int, end: int, choices: int) -> Path | None:
    """Frontier relaxation; (dist, hops) is minimised, then the node before."""
    spark = edges.sparkSession
    # what a node has stays (old = 0) unless something better comes (old = 1)
    label = F.struct("dist", "hops", "old", "prev", "w")
    one = "aid int, node long, dist long, hops int, old int, prev long, w long"
    state = cut(spark.createDataFrame([(i, start, 0, 0, 1, start, 0) for i in range(choices)], one))
    bound = None
    while True:
        fresh, bound = state.agg(F.sum("old"), F.min(F.when(F.col("node") == end, F.col("dist")))).first()
        if not fresh:
            break
        front = state.where("old = 1").select(F.col("aid").alias("__a"), F.col("node").alias("__u"), F.col("dist").alias("__d"), F.col("hops").alias("__h"))
        front = F.broadcast(front) if fresh <= BROADCAST_ROWS else front
        reached = edges.join(front, (F.col("__a") == F.col("aid")) & (F.col("__u") == F.col("src"))).select(
            "aid",
            F.col("dst").alias("node"),
            (F.col("__d") + F.col("weight")).alias("dist"),
            (F.col("__h") + 1).alias("hops"),
            F.lit(1).alias("old"),
            F.col("__u").alias("prev"),
            F.col("weight").alias("w"),
        )
        if bound is not None:  # weights are not negative: what is no better cannot become so
            reached = reached.where((F.col("dist") < bound) | ((F.col("dist") == bound) & (F.col("node") == end)))
        both = state.withColumn("old", F.lit(0)).unionByName(reached)
        state = cut(both.groupBy("aid", "node").agg(F.min(label).alias("m")).select("aid", "node", "m.*"))
    got = state.where(F.col("node") == end).orderBy("dist", "hops", "aid").first()
    if got is None:
        return None
    mine = state.where(F.col("aid") == got["aid"])

    def before(v: int):  # one lookup per step of the path found
        r = mine.where(F.col("node") == v).first()
        return r["prev"], r["w"]

    return _walk(before, start, end)
