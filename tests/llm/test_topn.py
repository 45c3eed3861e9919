import random

import pyarrow as pa
import pytest

from sheafline.llm import topn
from sheafline.llm.topn import top_n

SCHEMA = "dno long, salary int, ssn long, g string, s string, place int, file string"


def brute(rows, n):
    groups = {}
    for g, s, t in set(rows):
        if None not in (g, s, t):
            groups.setdefault(g, []).append((-s, t))
    return {(g, -s, t, k + 1) for g, v in groups.items() for k, (s, t) in enumerate(sorted(v)[:n])}


def run(spark, rows, n, **how):
    df = spark.createDataFrame([(*r, "a", "b", 1, "f") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in top_n(df, "dno", "salary", "ssn", n, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("n, row_group", [(1, 50), (5, 50), (5, 10_000)])
def test_equals_brute_force(spark, n, row_group):
    rng = random.Random(n)
    rows = [(rng.choice([7, 7, 7, *range(30), None]), rng.choice([None, 0, -5, *range(40)]), rng.choice([None, *range(300)])) for _ in range(3000)]
    rows += [(7, 39, 1)] * 500  # one row repeated: counts once
    assert run(spark, rows, n, head_rows=row_group, partitions=4) == brute(rows, n)


def test_ties_and_empty(spark):
    rows = [(1, 5, t) for t in range(20)]
    assert run(spark, rows, 3) == {(1, 5, 0, 1), (1, 5, 1, 2), (1, 5, 2, 3)}
    assert run(spark, [], 3) == set() == run(spark, [(None, 1, 1), (1, None, 1), (1, 1, None)], 3)
    with pytest.raises(ValueError):
        run(spark, rows, 0)


def test_row_groups_below_the_bound_are_not_read(spark):
    rows = [(g, s, s * 3 + g) for g in (1, 2) for s in range(4000)] + [(g, s, s) for g in range(10, 300) for s in range(g % 9)]
    seen = {}
    assert run(spark, rows, 5, head_rows=64, partitions=4, seen=seen) == brute(rows, 5)
    small = sum(1 for r in rows if r[0] >= 10)
    assert seen["rows_written"] == len(rows)
    assert seen["rows_read"].value < small + 4 * 500
    assert seen["groups_read"].value < seen["groups_written"]


def test_row_groups_end_where_large_groups_end():
    sizes = {1: 3, 2: 1000, 3: 5, 4: 63, 5: 64, 6: 1, 7: 2, 8: 200}
    g = [k for k, m in sizes.items() for _ in range(m)]
    t = pa.table({"g": g, "s": list(range(len(g)))})
    for step in (1, 7, 64, 5000):
        parts = list(topn._row_groups((b for b in t.to_batches(max_chunksize=step)), 64))
        assert pa.concat_tables(parts).equals(t)
        held = [p.column("g").unique().to_pylist() for p in parts]
        assert all(len(h) == 1 for h in held if {2, 5, 8} & set(h))
        assert [p.num_rows for p, h in zip(parts, held) if h == [2]] == [64, 128, 256, 512, 40]


def test_several_groups_are_skipped_after_a_look_at_them(tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t.parquet")
    with pq.ParquetWriter(path, pa.schema([("g", pa.int64()), ("s", pa.int32()), ("t", pa.int64())])) as w:
        for g, s in (([1] * 5 + [2] * 5, [9] * 10), ([1, 2], [3, 4]), ([1, 3], [5, 1]), ([2], [9])):
            w.write_table(pa.table({"g": g, "s": pa.array(s, pa.int32()), "t": list(range(len(g)))}, schema=w.schema))
    rgs = [{"rg": k, "n": n, "g_lo": lo, "g_hi": hi, "s_hi": hs} for k, (n, lo, hi, hs) in enumerate([(10, 1, 2, 9.0), (2, 1, 2, 4.0), (2, 1, 3, 5.0), (1, 2, 2, 9.0)])]
    read = []

    class Counter:
        def add(self, n):
            read.append(n)

    best = topn._best_of_file(pq.ParquetFile(path), sorted(rgs, key=lambda r: (-r["s_hi"], r["rg"])), 3, {"groups_read": Counter(), "rows_read": Counter()})
    assert read[1::2] == [10, 1, 2]  # the second one holds groups 1 and 2 alone, both above it
    assert len(best) == 7
