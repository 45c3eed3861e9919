import numpy as np
import pytest

from sheafline.functions.metrics import distances
from sheafline.operators.vector import knn, knn_many

V = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0, 0.0]), (3, [0.5] * 4), (4, [2.0] * 4)]
Q = [1.0, 0.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def vectors(spark):
    bad = [(5, None), (6, [1.0, None, 0.0, 0.0]), (7, [1.0, 0.0]), (None, Q), (8, [float("nan"), 0.0, 0.0, 0.0])]
    return spark.createDataFrame(V + bad, "id bigint, v array<float>").repartition(3)


@pytest.mark.parametrize(
    "metric, want",
    [
        ("MANHATTAN", [(0, 0), (2, 2000), (1, 20000), (3, 20000), (4, 70000)]),
        ("EUCLIDEAN", [(0, 0), (2, 1414), (3, 10000), (1, 14142), (4, 36055)]),
        ("COSINE", [(0, 0), (2, 61), (3, 5000), (4, 5000), (1, 10000)]),
    ],
)
def test_metrics(vectors, metric, want):
    got = [(r[0], r[1]) for r in knn(vectors, "id", "v", Q, 9, metric).collect()]
    assert got == want
    assert [(r[0], r[1]) for r in knn(vectors, "id", "v", Q, 3, metric).collect()] == want[:3]


def test_edges(spark, vectors):
    with pytest.raises(ValueError):
        knn(vectors, "id", "v", Q, 0, "COSINE")
    with pytest.raises(ValueError):
        knn(vectors, "id", "v", Q, 1, "HAMMING")
    assert knn(vectors.limit(0), "id", "v", Q, 3, "COSINE").count() == 0
    zero = distances(np.zeros((1, 2), np.float32), np.ones(2, np.float32), "COSINE")
    assert zero[0] == 0


@pytest.mark.parametrize("metric", ["MANHATTAN", "EUCLIDEAN", "COSINE"])
def test_many_queries_equal_single_ones(spark, vectors, metric):
    queries = spark.createDataFrame([(10, Q), (11, [0.5, 0.5, 0.0, 1.0]), (12, None), (None, Q), (13, [1.0]), (14, [0.0] * 4), (14, [0.0] * 4)], "q bigint, w array<float>")
    got = knn_many(vectors, "id", "v", queries, "q", "w", 3, metric, block=2).collect()
    for q, v in ((10, Q), (11, [0.5, 0.5, 0.0, 1.0]), (14, [0.0] * 4)):
        want = [(r["RecordID"], r["Similarity_Score"]) for r in knn(vectors, "id", "v", v, 3, metric).collect()]
        assert [(r["RecordID"], r["Similarity_Score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert {r["query_id"] for r in got} == {10, 11, 14}
    assert knn_many(vectors.limit(0), "id", "v", queries, "q", "w", 3, metric).count() == 0
