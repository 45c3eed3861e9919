import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from sheafline.operators import balanced
from sheafline.operators.balanced import heavy_keys, per_key

SCHEMA = "k long, v int, t int, n string, total string, __pid string"


def brute(rows):
    groups = defaultdict(list)
    for k, v, t, *_ in rows:
        groups[k].append((v, t))
    out = {}
    for k, g in groups.items():
        vs = [v for v, _ in g if v is not None]
        ts = sorted(t for _, t in g if t is not None)
        gap = max((b - a for a, b in zip(ts, ts[1:])), default=None) if k is not None else None
        out[k] = (len(g), sum(vs) if vs else None, ts[0] if ts else None, ts[-1] if ts else None, gap)
    return out


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_equals_brute_force_with_a_heavy_key(spark, parts):
    rng = random.Random(parts)
    rows = [(7 if i % 2 else rng.choice([None, *range(40)]), rng.choice([None, -1, 2, 5]), rng.choice([None, *range(500)]), "a", "b", "c") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["key"]: (r["n_rows"], r["total"], r["first_order"], r["last_order"], r["max_gap"]) for r in per_key(df, "k", "v", "t", parts).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("order", ["id", "cast(null as bigint)", "7", "id % 3", "cast('nan' as double)"])
def test_a_heavy_key_spreads_over_partitions(spark, monkeypatch, order):
    seen = []

    def watched(rows, partitions):
        out = ranged(rows, partitions)
        seen.extend(r[0] for r in out.selectExpr("spark_partition_id() as p").groupBy("p").count().select("count").collect())
        return out

    ranged = balanced._ranged
    monkeypatch.setattr(balanced, "_ranged", watched)
    df = spark.range(40_000).selectExpr("case when id % 10 < 8 then 1 else id end as k", "1 as v", f"{order} as t")
    got = per_key(df, "k", "v", "t", 8)
    assert [(r["key"], r["n_rows"], r["total"]) for r in heavy_keys(got, 0.02).collect()] == [(1, 32_000, 32_000)]
    assert max(seen) < 2 * sum(seen) / 8


def test_whole_numbers_are_exact(spark):
    big = 2**62
    ties = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (2, 1, 5), (3, 1, None), (3, 1, None)], "k int, v int, t int")
    assert {r["key"]: r["max_gap"] for r in per_key(ties, "k", "v", "t", 2).collect()} == {1: 0, 2: None, 3: None}
    rows = [(1, big + 1, -(2**63)), (1, big + 2, 2**63 - 1), (1, big, None), (2, 2**53 + 1, 2**53), (2, -1, 2**53 + 1)]
    got = {r["key"]: r for r in per_key(spark.createDataFrame(rows, "k int, v long, t long"), "k", "v", "t", 2).collect()}
    assert (got[1]["total"], got[1]["max_gap"]) == (3 * big + 3, 2**63 - 1)
    assert (got[2]["total"], got[2]["first_order"], got[2]["max_gap"]) == (2**53, 2**53, 1)


def test_timestamps_strings_and_dirt(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", 1.5, start), ("a", None, start + timedelta(seconds=90)), ("b", None, None), (None, 2.0, start)]
    df = spark.createDataFrame(rows, "k string, v double, t timestamp")
    got = {r["key"]: r for r in per_key(df, "k", "v", "t", 3).collect()}
    assert (got["a"]["n_rows"], got["a"]["total"], got["a"]["max_gap"]) == (2, 1.5, 90.0)
    assert (got["b"]["total"], got["b"]["first_order"], got["b"]["max_gap"]) == (None, None, None)
    assert (got[None]["n_rows"], got[None]["share"]) == (1, None)
    assert got["a"]["share"] == pytest.approx(2 / 3)
    assert per_key(df.limit(0), "k", "v", "t", 3).count() == 0
