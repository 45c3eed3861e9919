import random

import pytest

from sheafline.operators import hierarchy as hierarchy_module
from sheafline.operators.components import connected_components
from sheafline.operators.hierarchy import descendants, hierarchy


def solve(links):
    up = {a: (b if b in links else None) for a, b in links.items()}
    out = {}
    for a in up:
        seen, x = [], a
        while up[x] is not None and x not in seen:
            seen.append(x)
            x = up[x]
        if up[x] is None:
            out[a] = (x, len(seen), 0)
        else:
            at = seen.index(x)
            out[a] = (min(seen[at:]), at, 1)
    return out


def got(tree):
    return {r["node"]: (r["root"], r["depth"], r["cyclic"]) for r in tree.collect()}


def check(spark, links, limit):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in links.items()], "emp long, boss long, node int, path string")
    tree = hierarchy(df, "emp", "boss", local_limit=limit)
    rows = tree.collect()
    want = solve(links)
    assert {r["node"]: (r["root"], r["depth"], r["cyclic"]) for r in rows} == want
    bare = hierarchy(df, "emp", "boss", local_limit=limit, paths=False)
    assert bare.columns == ["node", "parent", "root", "depth", "cyclic"] and got(bare) == want
    paths = {r["node"]: list(r["path"]) for r in rows}
    for r in rows:
        assert len(r["path"]) == r["depth"] + 1 and r["path"][-1] == r["node"]
        for a, b in zip(r["path"], r["path"][1:]):
            assert links[b] == a
    below = {a: 0 for a in links}
    for p in paths.values():
        for a in p:
            below[a] += 1
    assert {r["node"]: r["subtree_size"] for r in rows} == below
    pairs = {(r[0], r[1], r[2]) for r in descendants(tree).collect()}
    assert pairs == {(p[i], p[-1], len(p) - 1 - i) for p in paths.values() for i in range(len(p) - 1)}


SHAPES = {
    "trees": {1: None, 2: 1, 3: 1, 4: 2, 5: 99, 6: 5},
    "cycles": {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 6, 7: 6, 8: None},
    "chain": {i: i - 1 for i in range(1, 40)},
    "star": {**{i: 1 for i in range(2, 60)}, 1: None},
}


@pytest.mark.parametrize("limit", [10**6, 3, 0])
@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape, limit):
    check(spark, SHAPES[shape], limit)


def test_random(spark):
    rng = random.Random(1)
    links = {i: rng.choice([None, *range(80)]) if rng.random() < 0.9 else 500 for i in range(80)}
    check(spark, links, 20)


def test_few_path_elements_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(hierarchy_module, "PATH_ELEMENTS", 7)
    check(spark, SHAPES["chain"], 100)


def test_dirt(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1), (2, 1), (2, None), (None, 1), (3, 7)], "n long, p long")
    assert got(hierarchy(df, "n", "p")) == {1: (1, 0, 0), 2: (1, 1, 0), 3: (3, 0, 0)}
    for limit in (10, 0):
        empty = hierarchy(df.limit(0), "n", "p", local_limit=limit)
        assert empty.count() == 0 and descendants(empty).count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_components(spark, limit):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (3, 1)] + [(i, i + 1) for i in range(10, 40)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, **{i: 10 for i in range(10, 41)}}
    assert {r[0]: r[1] for r in connected_components(df, "a", "b", local_edges=limit).collect()} == want
    assert connected_components(df.limit(0), "a", "b", local_edges=limit).count() == 0
