import numpy as np
import pytest

from sheafline.operators import integrity
from sheafline.relation import Relation


def plain(table):
    words = [len(table[0]) if table else 1]
    for i, row in enumerate(table):
        words.append(i)
        for j, v in enumerate(row):
            words += [j, v]
    state = integrity.BASIS
    for w in words:
        for b in int(w).to_bytes(8, "little", signed=True):
            state = ((state ^ b) * integrity.PRIME) % 2**64
    return f"{state:016X}"


B = [(1, 4), (2, 3), (3, 2), (4, 1)]


def test_known_fingerprint(spark):
    r = Relation.of(spark.createDataFrame(B, "a int, b int"))
    assert integrity.checksum(r) == ("79FDE9118763DAA1", 4)
    assert plain(B) == "79FDE9118763DAA1"


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_parallel_equals_sequential(spark, n):
    rng = np.random.default_rng(n)
    data = [tuple(map(int, r)) for r in rng.integers(-(2**40), 2**40, (n, 3))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "o int, a bigint, b bigint, c bigint").repartition(5)
    r = Relation.of(df, order=["o"])
    r = r.keep(r.fields[1:])
    assert integrity.checksum(r) == integrity.checksum(r, local_cells=0) == (plain(data), n)


def test_order_matters_and_empty(spark):
    r = Relation.of(spark.createDataFrame(B[::-1], "a int, b int"))
    assert integrity.checksum(r)[0] != plain(B)
    e = Relation.of(spark.createDataFrame([], "a int"))
    assert integrity.checksum(e) == integrity.checksum(e, local_cells=-1) == (plain([]), 0)


def test_only_whole_numbers(spark):
    with pytest.raises(TypeError):
        integrity.checksum(Relation.of(spark.createDataFrame([("x",)], "a string")))
    with pytest.raises(ValueError):
        integrity.checksum(Relation.of(spark.createDataFrame([(None,)], "a int")))
