import pytest

from sheafline.operators import aggregate, ordering, relational
from sheafline.operators.aggregate import Agg
from sheafline.operators.relational import On
from sheafline.plans.rewrites import wide_type
from sheafline.relation import Relation, block_geometry, matrix_geometry


def rel(spark, rows, schema, name="T", order=None):
    return Relation.of(spark.createDataFrame(rows, schema), name, order)


def rows(r):
    return [tuple(x) for x in r.to_df(ordered=True).collect()]


@pytest.fixture()
def t(spark):
    return rel(spark, [(3, 1), (1, None), (2, 1), (1, 2), (3, 1)], "a int, b int")


def test_every_comparison_and_nulls(t):
    want = {"<": [], ">": [(3, 1), (2, 1), (3, 1)], "==": [], "!=": [(3, 1), (2, 1), (1, 2), (3, 1)], "<=": [(1, 2)], ">=": [(3, 1), (2, 1), (3, 1)]}
    want["<"] = [(1, 2)]
    for op, out in want.items():
        assert rows(relational.select(t, "a", op, "b", column=True)) == out
    assert rows(relational.select(t, "b", "=>", 2)) == [(1, 2)]
    assert rows(relational.select(t, "b", "=<", 0)) == []


def test_project_keeps_repeats_and_order(t):
    assert rows(relational.project(t, ["b", "b", "a"]))[1] == (None, None, 1)
    assert len(rows(relational.project(t, ["b"]))) == 5
    with pytest.raises(ValueError):
        relational.project(t, [])


def test_rename(t):
    assert relational.rename(t, "a", "c").names == ["c", "b"]
    with pytest.raises(ValueError):
        relational.rename(t, "a", "b")


def test_cross_marks_only_clashing_names(spark, t):
    u = rel(spark, [(7, 8)], "b int, c int", "U")
    out = relational.cross(t, u, "T", "U")
    assert out.names == ["a", "T_b", "U_b", "c"]
    assert relational.cross(t, t, "T", "T").names == ["T1_a", "T1_b", "T2_a", "T2_b"]
    assert rows(relational.cross(u, u, "U", "U")) == [(7, 8, 7, 8)]


def test_cross_order_is_left_outside(spark):
    a, b = rel(spark, [(2,), (1,)], "x int"), rel(spark, [(5,), (4,)], "y int")
    assert rows(relational.cross(a, b, "A", "B")) == [(2, 5), (2, 4), (1, 5), (1, 4)]


def test_joins(spark):
    a = rel(spark, [(i, 10 + i) for i in range(1, 11)], "a int, b int", "A")
    b = rel(spark, [(1, 4), (2, 3), (3, 2), (4, 1), (None, None)], "a int, b int", "B")
    plus = relational.join(a, b, "A", "B", On(("A", "a"), ("B", "b"), "+", 5), columns=[("A", "a"), ("A", "b"), ("B", "b")])
    assert sorted(rows(plus)) == [(1, 11, 4), (2, 12, 3), (3, 13, 2), (4, 14, 1)]
    minus = relational.join(a, b, "A", "B", On(("A", "a"), ("B", "b"), "-", 5), columns=[("A", "a"), ("B", "b")])
    assert sorted(rows(minus)) == [(6, 1), (7, 2), (8, 3), (9, 4)]
    swapped = relational.join(a, b, "A", "B", On(("B", "b"), ("A", "a"), "-", 2), columns=[("A", "a"), ("B", "b")])
    assert sorted(rows(swapped)) == [(1, 3), (2, 4)]
    both = relational.join(a, b, "A", "B", On(("A", "a"), ("B", "a")), (("B", "b"), ">", 2))
    assert both.names == ["a", "b", "a", "b"]
    assert both.to_df().columns == ["a", "b", "B_a", "B_b"]
    assert sorted(rows(both)) == [(1, 11, 1, 4), (2, 12, 2, 3)]
    itself = relational.join(b, b, "B", "B", On(("B", "a"), ("B", "b")))
    assert sorted(rows(itself)) == [(1, 4, 4, 1), (2, 3, 3, 2), (3, 2, 2, 3), (4, 1, 1, 4)]
    with pytest.raises(KeyError):
        relational.join(a, b, "A", "B", On(("A", "a"), ("A", "b")))


def test_arithmetic_join_hashes_and_does_not_overflow(spark):
    big = 2**31 - 1
    a, b = rel(spark, [(big,)], "x int", "A"), rel(spark, [(big,)], "y int", "B")
    out = relational.join(a, b, "A", "B", On(("A", "x"), ("B", "y"), "+", 5))
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(out) == []
    huge = 2**63 - 1
    a, b = rel(spark, [(huge,), (5,)], "x bigint", "A"), rel(spark, [(huge,), (-2,)], "y bigint", "B")
    assert rows(relational.join(a, b, "A", "B", On(("A", "x"), ("B", "y"), "+", 3))) == [(5, -2)]
    assert wide_type(["int", "smallint"], 5) == "bigint" != wide_type(["int", "bigint"], 5) == wide_type(["int"], 2**62)


def test_distinct_keeps_first_occurrence(t):
    assert rows(relational.distinct(t)) == [(3, 1), (1, None), (2, 1), (1, 2)]
    assert rows(relational.distinct(relational.project(t, ["a"]))) == [(3,), (1,), (2,)]


def test_group_by(spark):
    t = rel(spark, [(1, 10, -3), (1, 20, -1), (2, 5, 7), (None, 5, 0)], "k int, v int, w int")
    some = (Agg("COUNT", "*"), ">", 0)
    avg, by_v = aggregate.group_by(t, ["k", "v"], some, [Agg("AVG", "w"), Agg("COUNT", "*")])
    assert avg.names == ["k", "AVGw"] and by_v.names == ["v", "COUNT"]
    assert rows(avg) == [(None, 0), (1, -2), (2, 7)]
    assert rows(by_v) == [(5, 2), (10, 1), (20, 1)]
    assert rows(aggregate.group_by(t, ["k"], (Agg("MAX", "v"), ">", Agg("SUM", "v")), [Agg("MIN", "v")])[0]) == []
    assert rows(aggregate.group_by(t, ["k"], (Agg("SUM", "w"), "<", 0), [Agg("AVG", "v")])[0]) == [(1, 15)]


@pytest.mark.parametrize("numbers", [[1, 2], [-1, -2], [-3, 2], [7], [-5, 1, 1], [2**40, 1]])
def test_average_is_rounded_up(spark, numbers):
    import math
    from fractions import Fraction

    t = rel(spark, [(1, n) for n in numbers], "k int, v bigint")
    got = rows(aggregate.group_by(t, ["k"], (Agg("COUNT", "*"), ">", 0), [Agg("AVG", "v")])[0])
    assert got == [(1, math.ceil(Fraction(sum(numbers), len(numbers))))]


def test_sort_is_stable(spark):
    t = rel(spark, [(i, i % 3) for i in range(20)], "i int, k int")
    out = rows(ordering.sort(t, ["k"], [False]))
    assert out == sorted(out, key=lambda r: (-r[1], r[0]))


def test_sort_of_the_ends_leaves_the_middle(spark):
    t = rel(spark, [(i, 10 + i) for i in range(1, 11)], "a int, b int")
    out = ordering.sort_segments(t, ["b"], [False], 3, 2)
    assert [r[0] for r in rows(out)] == [3, 2, 1, 4, 5, 6, 7, 8, 10, 9]
    again = ordering.sort_segments(out, ["a"], [True], 3, None)
    assert [r[0] for r in rows(again)] == [1, 2, 3, 4, 5, 6, 7, 8, 10, 9]
    assert rows(relational.distinct(again))[-2:] == [(10, 20), (9, 19)]
    assert rows(ordering.sort_segments(t, ["b"], [False], 0, None)) == rows(t)
    for top, bottom in ((11, None), (6, 5), (-1, None)):
        with pytest.raises(ValueError):
            ordering.sort_segments(t, ["b"], [True], top, bottom)


def test_numbering_over_many_partitions(spark):
    df = spark.range(1000).repartition(7)
    out = Relation.of(df, order=["id"]).numbered()
    assert [tuple(r) for r in out.df.orderBy("__ord").limit(3).collect()] == [(0, 0), (1, 1), (2, 2)] or all(
        r[0] == r[1] for r in out.df.collect()
    )
    assert out.df.where(f"{out.fields[0].physical} <> __ord").count() == 0


def test_empty_tables(spark):
    e = rel(spark, [], "a int, b int")
    assert rows(relational.select(e, "a", ">", 1)) == rows(relational.distinct(e)) == rows(e) == []
    assert rows(relational.cross(e, e, "E", "E")) == []
    assert rows(ordering.sort_segments(e, ["a"], [True], 0, 0)) == []
    assert rows(aggregate.group_by(e, ["a"], (Agg("COUNT", "*"), ">", 0), [Agg("AVG", "b")])[0]) == []


def test_block_geometry():
    assert block_geometry(8, 6) == (41, 1) and block_geometry(5000, 10) == (25, 200) and block_geometry(0, 2) == (125, 0)
    assert matrix_geometry(5, 4) == (51, 1) and matrix_geometry(1000, 50) == (5, 200) and matrix_geometry(1, 5000) == (1, 1)
