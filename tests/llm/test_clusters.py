import itertools
import math
import random

import numpy as np
import pytest

from sheafline.llm import clusters
from sheafline.llm.cliques import best_first
from sheafline.llm.clusters import cliques, similarity_clusters, typical_members

R = 0.3
SCHEMA = "record_id long, c0 float, c1 float, id string, n int, label string, cluster_id int"


def frame(spark, points):
    return spark.createDataFrame([(i, *p, "x", 1, "y", 2) for i, p in points], SCHEMA).repartition(3)


def f32(v):
    return float(np.float32(v))


def brute(points, size):
    """Maximal sets by checking all, then the larger of overlapping ones."""
    seen = {}
    for i, p in points:
        if i is not None and all(x is not None and math.isfinite(x) for x in p) and any(p):
            seen[i] = tuple(f32(x) for x in p)
    near = {a: {b for b in seen if a != b and math.dist(seen[a], seen[b]) <= R} for a in seen}
    found = []

    def grow(r, p, x):
        if not p and not x:
            found.append(r)
        for v in list(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(frozenset(), frozenset(seen), frozenset())
    out, taken = {}, set()
    for c in sorted((c for c in found if len(c) >= size), key=lambda c: (-len(c), sorted(c))):
        if not c & taken:
            taken |= c
            out |= {i: min(c) for i in c}
    return out


@pytest.mark.parametrize("seed, pairs", [(0, 4096), (1, 4096), (2, 4096), (0, 1), (1, 1), (2, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, pairs):
    monkeypatch.setattr(clusters, "PAIR_ROWS", pairs)
    rng = random.Random(seed)
    points = []
    for k in range(12):
        x, y, s = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.choice([0.02, 0.08, 0.2])
        points += [(100 * k + j, (x + rng.gauss(0, s), y + rng.gauss(0, s))) for j in range(rng.randint(3, 12))]
    points += [(5000 + i, (rng.uniform(-5, 5), rng.uniform(-5, 5))) for i in range(30)]
    points += [(9000, (1e30, 1.0)), (9001, (None, 1.0)), (9002, (float("nan"), 1.0)), (9003, (0.0, 0.0)), (9004, (float("inf"), 1.0)), (None, (1.0, 1.0))]
    points += points[:20] + [(7000 + i, points[0][1]) for i in range(4)]
    got = cliques(similarity_clusters(frame(spark, points), "record_id", ["c0", "c1"], R), 3)
    assert {r[0]: r[1] for r in got.collect()} == brute(points, 3)


@pytest.mark.parametrize("pairs", [4096, 300])
def test_one_component_of_two_thousand_vectors(spark, monkeypatch, pairs):
    monkeypatch.setattr(clusters, "PAIR_ROWS", pairs)
    rng = random.Random(pairs)
    points = [(i, (rng.uniform(0, 14), rng.uniform(0, 3.5))) for i in range(2000)]
    c = similarity_clusters(frame(spark, points), "record_id", ["c0", "c1"], R)
    assert c.clusters.groupBy("component").sum("n_vectors").agg({"sum(n_vectors)": "max"}).first()[0] > 1900
    assert {r[0]: r[1] for r in cliques(c, 6).collect()} == brute(points, 6)


def test_a_component_too_large_for_one_task_is_agglomerated_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(clusters, "WARD_ROWS", 50)
    rng = random.Random(8)
    points = [(i, (rng.uniform(0, 30), rng.uniform(0, 1))) for i in range(1500)]
    c = similarity_clusters(frame(spark, points), "record_id", ["c0", "c1"], R)
    assert c.assigned.selectExpr("shiftright(label, 32) as t").distinct().count() > 3
    assert typical_members(c).agg({"size": "sum"}).first()[0] == 1500
    assert {r[0]: r[1] for r in cliques(c, 4).collect()} == brute(points, 4)


@pytest.mark.parametrize("seed", range(4))
def test_best_first_equals_the_list_of_all_sets(seed):
    rng = np.random.default_rng(seed)
    m = 300
    x = rng.normal(0, [0.2, 0.3, 0.5, 1.0][seed], (m, 3))
    n, vid = rng.integers(1, 3, m), rng.permutation(m) * 3 - 50
    want = clusters._component_cliques(x, n, vid, np.zeros(m, int), R, 5)
    assert (best_first(x, n, vid, R, 5) == want).all()


def test_copies_clusters_and_members(spark):
    points = [(i, (1.0, 1.0)) for i in range(50)] + [(60 + i, (1.0 + 0.01 * i, 1.0)) for i in range(1, 4)] + [(99, (9.0, 9.0))]
    c = similarity_clusters(frame(spark, points), "record_id", ["c0", "c1"], R)
    got = {r["cluster_id"]: r for r in typical_members(c, 2).collect()}
    assert got[0]["size"] == 53 and got[0]["members"][0] == 0 and got[99]["members"] == [99]
    assert cliques(c, 6).count() == 53
    assert typical_members(c).groupBy().sum("size").first()[0] == 54


def test_every_record_gets_one_cluster(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.4, (400, 2))
    c = similarity_clusters(frame(spark, [(i, tuple(map(float, p))) for i, p in enumerate(x)]), "record_id", ["c0", "c1"], R)
    assert c.vectors.select("vid").distinct().count() == c.vectors.count() == 400
    assert c.clusters.count() > 3


def test_empty(spark):
    for points in ([], [(1, (0.0, 0.0))]):
        c = similarity_clusters(frame(spark, points), "record_id", ["c0", "c1"], R)
        assert typical_members(c).count() == 0 and cliques(c, 2).count() == 0


def test_ward_climbs_the_tree_and_search_gives_up_gracefully(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 2, (300, 2))
    monkeypatch.setattr(clusters, "WARD_LEAVES", 20)
    monkeypatch.setattr(clusters, "CLIQUE_STEPS", 50)
    c = similarity_clusters(frame(spark, [(i, tuple(map(float, p))) for i, p in enumerate(x)]), "record_id", ["c0", "c1"], R)
    near = lambda a, b: math.dist([f32(v) for v in x[a]], [f32(v) for v in x[b]]) <= R
    groups = {}
    for r in cliques(c, 3).collect():
        groups.setdefault(r[1], []).append(r[0])
    assert groups and all(near(a, b) for g in groups.values() for a, b in itertools.combinations(g, 2))


def test_ward():
    n = np.array([3.0, 2.0, 5.0])
    mean = np.array([[0.0], [0.1], [5.0]])
    label = clusters._ward(n, mean, np.zeros(3), 0.25)
    assert label[0] == label[1] != label[2]


@pytest.mark.parametrize("seed", range(6))
def test_search_by_bounds_equals_the_list_of_all_cliques(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    m = 90
    x = rng.normal(0, [0.1, 0.16, 0.3][seed % 3], (m, 3))
    n, vid, label = rng.integers(1, 2 + seed % 3, m), rng.permutation(m) * 7 - 100, rng.integers(0, 5, m)
    whole = clusters._component_cliques(x, n, vid, label, R, 3)
    monkeypatch.setattr(clusters, "CLIQUE_STEPS", 50)
    assert (clusters._component_cliques(x, n, vid, label, R, 3) == whole).all()


def test_search_beyond_the_list_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CLIQUE_STEPS", 5)
    rng = random.Random(3)
    points = [(i, (rng.gauss(0, 0.2), rng.gauss(0, 0.2))) for i in range(60)]
    got = cliques(similarity_clusters(frame(spark, points), "record_id", ["c0", "c1"], R), 3)
    assert {r[0]: r[1] for r in got.collect()} == brute(points, 3)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_leaves_of_large_components_are_agglomerated_as_of_small_ones(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    mean = rng.uniform(0, 2, (150, 2))
    n = rng.integers(1, 9, 150).astype(float)
    sse = n * rng.uniform(0, 1e-3, 150)
    rows = np.column_stack([n, sse + n * (mean**2).sum(1), mean * n[:, None], np.rint(mean / (R / clusters.SPLIT))])
    small = clusters._component_ward(rows, 2, R)
    monkeypatch.setattr(clusters, "WARD_LEAVES", 20)
    large = clusters._component_ward(rows, 2, R)
    for a, b in zip([*small[0], *small[1]], [*large[0], *large[1]]):
        assert np.allclose(a, b)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_leaves_list_every_centroid_that_may_be_nearest(seed):
    rng = np.random.default_rng(seed)
    side = R / clusters.SPLIT * (1 + 1e-6)
    points = rng.uniform(0, 0.9, (3000, 3))
    keys, leaf = np.unique(np.rint(points / side), axis=0, return_inverse=True)
    leaf = leaf.ravel()
    n = np.bincount(leaf).astype(float)
    sums = np.column_stack([np.bincount(leaf, points[:, j]) for j in range(3)])
    ss = np.bincount(leaf, (points**2).sum(1))
    cands, cents = clusters._component_ward(np.column_stack([n, ss, sums, keys]), 3, R)
    centroid = {int(k): c for a, b in zip(cands, cents) for k, c in zip(a, b.reshape(-1, 3))}
    names = np.array(sorted(centroid))
    d = np.linalg.norm(points[:, None] - np.array([centroid[k] for k in names])[None], axis=2)
    assert all(k in cands[at] for k, at in zip(names[d.argmin(1)], leaf))


@pytest.mark.parametrize("rows", [50, 500])
def test_clusters_of_a_component_do_not_depend_on_how_many_leaves_one_task_takes(spark, monkeypatch, rows):
    rng = random.Random(9)
    points = [(i, (rng.uniform(0, 30), rng.uniform(0, 1))) for i in range(1500)]
    points += [(2000 + i, (round(rng.uniform(0, 30), 1), 0.5)) for i in range(300)]
    found = []
    for most in (20_000, rows):
        monkeypatch.setattr(clusters, "WARD_ROWS", most)
        c = similarity_clusters(frame(spark, points).coalesce(1), "record_id", ["c0", "c1"], R)
        found.append(sorted(map(tuple, c.assigned.join(c.clusters, ["component", "label"]).select("vid", "cluster_id", "size").collect())))
    assert len({r[1] for r in found[0]}) > 100
    assert found[0] == found[1]


@pytest.mark.parametrize("seed, width", [(0, 2), (1, 2), (2, 3), (3, 4)])
def test_ward_by_a_grid_equals_ward_by_all_pairs(monkeypatch, seed, width):
    rng = np.random.default_rng(seed)
    mean = rng.uniform(0, 2.5, (500, width))
    mean[:200] = np.rint(mean[:200] / 0.1) * 0.1  # equal costs
    n, ids = rng.choice([1.0, 1.0, 3.0, 400.0], 500), rng.permutation(500) * 3 - 40
    sse = n * rng.uniform(0, 1e-3, 500)
    want = clusters._ward(n, mean, sse, (0.75 * R) ** 2, ids)
    monkeypatch.setattr(clusters, "WARD_LEAVES", 10)
    monkeypatch.setattr(clusters, "WARD_PAIRS", 5_000)
    assert (clusters._ward(n, mean, sse, (0.75 * R) ** 2, ids) == want).all()
    assert want.max() < 450


def test_merges_of_equal_costs_are_made_in_few_rounds(monkeypatch):
    rounds, partners = [], clusters._partners
    monkeypatch.setattr(clusters, "_partners", lambda *a: rounds.append(1) or partners(*a))
    mean = np.column_stack([np.arange(2000) * 0.1, np.zeros(2000)])
    assert clusters._ward(np.ones(2000), mean, np.zeros(2000), (0.75 * R) ** 2).max() < 1000
    assert len(rounds) < 40
