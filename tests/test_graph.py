import heapq
import random

import numpy as np
import pytest

from sheafline.operators import graph
from sheafline.operators.graph import Condition
from sheafline.relation import GraphModel, Relation


def model(spark, nodes, edges, node_attrs=1, edge_attrs=1, directed=True):
    n = "id int" + "".join(f", A{i + 1} int" for i in range(node_attrs))
    e = "s int, d int, w int" + "".join(f", B{i + 1} int" for i in range(edge_attrs))
    return GraphModel(Relation.of(spark.createDataFrame(nodes, n)), Relation.of(spark.createDataFrame(edges, e)), directed)


@pytest.fixture(scope="module")
def g(spark):
    nodes = [(1, 0, 1, 1, 1), (2, 1, 1, 0, 1), (3, 1, 1, 1, 1), (4, 1, 1, 1, 1)]
    edges = [(1, 2, 10, 0, 1, 0, 1), (1, 3, 12, 1, 1, 1, 1), (2, 4, 6, 0, 0, 1, 1), (3, 4, 20, 1, 1, 1, 1)]
    return model(spark, nodes, edges, 4, 4)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_conditions(g, limit):
    find = lambda *c: graph.shortest_path(g, 1, 4, list(c), local_edges=limit)
    p = find(Condition(True, "A3", 1), Condition(False, "B2"))
    assert (p.weight, p.nodes, p.edges) == (32, [1, 3, 4], [(1, 3, 12), (3, 4, 20)])
    assert find(Condition(True, "A1", 1), Condition(True, "A3", 0), Condition(False, None, 1)) is None
    assert find(Condition(True, "A2", 1)).weight == 16
    assert find(Condition(True, "NOPE")) is None
    assert find().weight == 16


def test_minimum_over_all_choices(spark):
    g = model(spark, [(0, 0), (1, 0)], [(0, 1, 9, 0), (0, 1, 2, 1)])
    assert graph.shortest_path(g, 0, 1, [Condition(False, "B1")]).weight == 2
    assert graph.shortest_path(g, 0, 0, []).weight == 0


def test_degrees(spark):
    nodes = [(i, 0) for i in range(4)] + [(0, 0), (None, 1)]
    edges = [(0, 1, 1, 0), (1, 2, 1, 0), (2, 2, 1, 0), (None, 1, 1, 0), (9, 0, 1, 0)]
    for directed in (True, False):
        g = model(spark, nodes, edges, directed=directed)
        assert {r[0]: r[1] for r in graph.degrees(g).collect()} == {0: 2, 1: 3, 2: 3, 3: 0}
        assert (graph.degree(g, 2), graph.degree(g, 3), graph.degree(g, 9)) == (3, 0, None)


def test_undirected_paths_run_both_ways(spark):
    g = model(spark, [(i, 0) for i in range(3)], [(1, 0, 2, 0), (1, 2, 3, 0)], directed=False)
    assert graph.shortest_path(g, 0, 2).weight == 5
    assert graph.shortest_path(model(spark, [(i, 0) for i in range(3)], [(1, 0, 2, 0), (1, 2, 3, 0)]), 0, 2) is None


def test_dirty_edges(spark):
    g = model(spark, [(0, 0), (1, 0)], [(0, 1, None, 0), (None, 1, 1, 0), (0, 7, 1, 0), (7, 1, 1, 0), (0, 1, 10, None), (0, 1, 5, 0)])
    assert graph.shortest_path(g, 0, 1).weight == 5
    with pytest.raises(ValueError):
        graph.shortest_path(model(spark, [(0, 0), (1, 0)], [(0, 1, -1, 0)]), 0, 1)
    assert graph.shortest_path(model(spark, [(0, 0), (1, 0)], []), 0, 1) is None


def brute(n, edges, s, t):
    dist, heap = {}, [(0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in dist:
            continue
        dist[v] = d
        for a, b, w, *_ in edges:
            if a == v and b not in dist:
                heapq.heappush(heap, (d + w, b))
    return dist.get(t)


def test_frontiers_equal_the_heap(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(30):
        src, dst, w = rng.integers(0, 20, 60), rng.integers(0, 20, 60), rng.integers(0, 6, 60)
        a, b = graph._search(src, dst, w, 0, 7), graph._dijkstra(src, dst, w, 0, 7)
        assert (a is None) == (b is None)
        if a:
            assert (a.weight, len(a.edges)) == (b.weight, len(b.edges)) and a.nodes[0] == 0 and a.nodes[-1] == 7
    chain = np.arange(300)
    monkeypatch.setattr(graph, "MOST_ROUNDS", 50)
    assert graph._search(chain, chain + 1, chain * 0 + 2, 0, 300).weight == 600
    assert graph._search(chain, chain + 1, chain * 0 + 2**58, 0, 2).weight == 2**59


@pytest.mark.parametrize("seed", range(3))
def test_joins_equal_local_search_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 30
    nodes = [(i, rng.randint(0, 1)) for i in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 9), rng.randint(0, 1)) for _ in range(90)]
    g = model(spark, nodes, edges)
    for s, t in ((0, 7), (3, 21)):
        plain = graph.shortest_path(g, s, t)
        assert (plain.weight if plain else None) == brute(n, edges, s, t)
        any_edge = [brute(n, [e for e in edges if e[3] == v], s, t) for v in (0, 1)]
        want = min([x for x in any_edge if x is not None], default=None)
        for limit in (10**6, 0):
            p = graph.shortest_path(g, s, t, [Condition(False, None)], local_edges=limit)
            assert (p.weight if p else None) == want
            if p:
                assert sum(e[2] for e in p.edges) == p.weight and [e[0] for e in p.edges] + [t] == p.nodes


def test_repeated_open_conditions_try_every_attribute(spark):
    edges = [(0, 1, 9, 0, 0, 0), (0, 1, 8, 0, 1, 1), (0, 1, 2, 1, 0, 1)]
    for keep in range(3):
        lone = [(0, 1, 1, *[1 if k == keep else 7 for k in range(3)])]  # only this attribute is 0 or 1
        g = model(spark, [(0, 0), (1, 0)], lone, edge_attrs=3)
        assert graph.shortest_path(g, 0, 1, [Condition(False, None)] * 5).weight == 1
        assert graph.shortest_path(g, 0, 1, [Condition(False, None)] * 9).weight == 1
    g = model(spark, [(0, 0), (1, 0)], edges, edge_attrs=3)
    assert graph.shortest_path(g, 0, 1, [Condition(False, None)] * 5).weight == 2
