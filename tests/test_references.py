from datetime import datetime as D

import pytest

from sheafline import runtime
from sheafline.operators.references import Child, Parent, orphan_counts, orphan_references, with_period

JAN, FEB, MAR = D(2023, 1, 5), D(2023, 2, 5), D(2023, 3, 5)


@pytest.fixture(params=[10**6, 0])
def bound(request, monkeypatch):
    """Both ways to look keys up: by broadcast and, beyond its bound, by shuffle."""
    monkeypatch.setattr(runtime.lookup_join, "__defaults__", ("left", request.param))


def tables(spark, work, staff):
    w = spark.createDataFrame(work, "id long, who long, at timestamp, key string, reason int")
    s = spark.createDataFrame(staff, "ssn long, loaded timestamp, gone timestamp, at string")
    return [Child("w.who", w, "id", "who", "at", "s")], [Parent("s", s, "ssn", "loaded", "gone")]


def test_reasons(spark, bound):
    work = [
        (1, 10, FEB, "", 0),
        (1, 10, FEB, "", 0),
        (2, 11, FEB, "", 0),
        (3, 11, MAR, "", 0),
        (4, 12, JAN, "", 0),
        (5, 12, FEB, "", 0),
        (6, 99, JAN, None, None),
        (7, None, JAN, "", 0),
        (8, 99, None, "", 0),
        (9, 11, None, "", 0),
        (10, 13, FEB, "", 0),
    ]
    staff = [(10, JAN, None, ""), (11, JAN, MAR, ""), (12, FEB, None, ""), (12, FEB, None, ""), (13, JAN, FEB, ""), (13, FEB, None, ""), (None, JAN, None, "")]
    out = orphan_references(*tables(spark, work, staff))
    assert {tuple(r) for r in with_period(out).collect()} == {
        ("w.who", 3, "deleted", "2023-03"),
        ("w.who", 4, "late", "2023-01"),
        ("w.who", 6, "missing", "2023-01"),
        ("w.who", 8, "missing", None),
    }
    assert out.count() == 4
    assert {tuple(r) for r in orphan_counts(out).collect()} >= {("w.who", "missing", "2023-01", 1)}


def test_hot_key(spark, bound):
    work = [(i, 99 if i % 2 else i, JAN, "", 0) for i in range(2000)]
    out = orphan_references(*tables(spark, work, [(i, JAN, None, "") for i in range(2000) if i not in (99, 1000)]))
    assert out.count() == 1001 and out.where("ref_id = 1000").count() == 1


def test_empty(spark, bound):
    work = [(1, 10, JAN, "", 0)]
    assert orphan_references(*tables(spark, [], [(10, JAN, None, "")])).count() == 0
    got = orphan_references(*tables(spark, work, [])).collect()
    assert [r["reason"] for r in got] == ["missing"]


def test_in_force(spark):
    df = spark.createDataFrame([(1, JAN, 5, "x"), (1, FEB, None, "y"), (1, FEB, None, "y"), (2, None, 1, "z"), (2, JAN, 2, None)], "k long, at timestamp, v int, `odd name` string")
    assert {tuple(r) for r in runtime.in_force(df, "k", "at").collect()} == {(1, FEB, None, "y"), (2, JAN, 2, None)}
