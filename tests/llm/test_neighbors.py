import math
import random

import numpy as np
import pytest

from sheafline import runtime
from sheafline.llm import neighbors
from sheafline.llm.neighbors import fit_router, nearest_neighbours

SCHEMA = "record_id long, c0 float, c1 float, c2 float, vid long, n int, ids string, home string, d string"


def frame(spark, points):
    return spark.createDataFrame([(i, *p, 1, 1, "x", "y", "z") for i, p in points], SCHEMA).repartition(3)


def brute(points, k, limit):
    seen = {}
    for i, p in points:
        if i is not None and all(x is not None and math.isfinite(x) for x in p) and any(p):
            seen[i] = [float(np.float32(x)) for x in p]
    out = {}
    for a, x in seen.items():
        near = sorted((math.sqrt(sum((p - q) ** 2 for p, q in zip(x, y))), b) for b, y in seen.items() if b != a)
        out[a] = [b for d, b in near if limit is None or d <= limit][:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


def points(seed, n=400):
    rng = random.Random(seed)
    centres = [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(20)]
    out = [(i, tuple(c + rng.gauss(0, 0.15) for c in rng.choice(centres))) for i in range(n)]
    out += [(1000 + i, out[0][1]) for i in range(9)] + [(2000 + i, out[1][1]) for i in range(2)] + out[:30]
    out += [(3000, (1e30, 1.0, 1.0)), (3001, (None, 1.0, 1.0)), (3002, (float("nan"), 0.0, 1.0)), (3003, (0.0, 0.0, 0.0)), (None, (1.0, 1.0, 1.0))]
    return out


@pytest.mark.parametrize("limit, part", [(0.3, 40), (None, 40), (0.3, 10_000), (0.05, 25)])
def test_equals_brute_force(spark, limit, part):
    p = points(part)
    got = result(nearest_neighbours(frame(spark, p), "record_id", ["c0", "c1", "c2"], 3, limit, part_rows=part, probes=2))
    assert got == {a: b for a, b in brute(p, 3, limit).items() if b}


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(runtime.lookup_join, "__defaults__", ("left", 0))
    p = points(3, 150)
    got = result(nearest_neighbours(frame(spark, p), "record_id", ["c0", "c1", "c2"], 3, 0.3, part_rows=30, probes=1))
    assert got == {a: b for a, b in brute(p, 3, 0.3).items() if b}


@pytest.mark.parametrize("limit", [0.3, None])
def test_large_parts_are_searched_in_slices(spark, monkeypatch, limit):
    monkeypatch.setattr(neighbors, "MAX_PARTS", 3)
    p = points(7)
    got = result(nearest_neighbours(frame(spark, p), "record_id", ["c0", "c1", "c2"], 3, limit, part_rows=10, probes=1))
    assert got == {a: b for a, b in brute(p, 3, limit).items() if b}


def test_recall_of_the_first_pass(spark):
    p = points(11, 1500)
    ask = dict(k=3, max_distance=0.3, part_rows=100)
    first = result(nearest_neighbours(frame(spark, p), "record_id", ["c0", "c1", "c2"], exact=False, **ask))
    want = brute(p, 3, 0.3)
    hit = sum(len(set(first.get(a, [])) & set(b)) for a, b in want.items())
    assert hit / sum(map(len, want.values())) >= 0.9


def test_queries_divisible_by_fifty(spark):
    p = points(5)
    got = result(nearest_neighbours(frame(spark, p), "record_id", ["c0", "c1", "c2"], 3, 0.3, part_rows=50, every=50))
    assert got == {a: b for a, b in brute(p, 3, 0.3).items() if b and a % 50 == 0}


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(2000, 4))
    r = fit_router(x, 16)
    home = np.argmax(r.log_probs(x), axis=1)
    assert np.allclose(np.exp(r.log_probs(x)).sum(1), 1) and np.bincount(home, minlength=16).max() < 3 * 2000 / 16


def test_few_rows(spark):
    names = ["c0", "c1", "c2"]
    assert nearest_neighbours(frame(spark, []), "record_id", names).count() == 0
    assert nearest_neighbours(frame(spark, [(1, (1.0, 1.0, 1.0))]), "record_id", names).count() == 0
    two = frame(spark, [(1, (1.0, 1.0, 1.0)), (2, (1.0, 1.0, 1.0))])
    assert result(nearest_neighbours(two, "record_id", names)) == {1: [2], 2: [1]}
