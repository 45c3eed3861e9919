"""Exact nearest neighbours of one query vector, or of many."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, distances, score


def knn(df: DataFrame, id_col: str, vec_col: str, query: list[float], k: int, metric: str) -> DataFrame:
    """(RecordID, Similarity_Score, distance) of the ``k`` nearest rows, nearest first.

    Distances are single precision, summed from the first component to the
    last; of equal ones the smaller id comes first. A zero vector has cosine
    distance 0 to everything. Vectors that are null, or have null components or
    another length than the query, are ignored, as are NaN distances. Each
    partition is reduced to its own k nearest before the last ordering.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    q = np.array(query, np.float32)

    def run(batches):
        best = pd.DataFrame({"RecordID": np.zeros(0, np.int64), "distance": np.zeros(0, np.float32)})
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(np.float32)
                d = distances(x, q, metric)
                one = pd.DataFrame({"RecordID": b["id"].to_numpy(np.int64), "distance": d}).dropna()
                best = one if best.empty else pd.concat([best, one], ignore_index=True)
                best = best.sort_values(["distance", "RecordID"], kind="stable").head(k)
        yield best

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") == len(query)) & ~F.exists("v", lambda e: e.isNull()))
    near = rows.mapInPandas(run, "RecordID long, distance float").orderBy("distance", "RecordID").limit(k)
    return near.select("RecordID", score(F.col("distance")).alias("Similarity_Score"), "distance")


#: Query vectors that tasks hold at a time.
BLOCK_QUERIES = 1_000


def knn_many(
    df: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, query_vec: str, k: int, metric: str, block: int = BLOCK_QUERIES
) -> DataFrame:
    """(query_id, RecordID, Similarity_Score, distance, rank) of the ``k`` nearest rows of every query.

    Distances, ties and ignored rows are those of :func:`knn`; queries with a
    null id, or a vector that is null or holds nulls, are ignored, and rows of
    another length than a query do not answer it. Queries stream in blocks of
    ``block``, each against all rows in one scan; a task keeps k rows a query.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    sc = df.sparkSession.sparkContext
    rows = _vectors(df, id_col, vec_col)
    out = df.sparkSession.createDataFrame([], "query_id long, RecordID long, distance float")
    asked = _vectors(queries, query_id, query_vec).distinct().toLocalIterator()
    while some := list(itertools.islice(asked, block)):
        shared = sc.broadcast([(r["id"], np.array(r["v"], np.float32)) for r in some])  # at most ``block`` vectors
        out = out.unionByName(rows.mapInPandas(_nearest_of_many(shared, k, metric), "query_id long, RecordID long, distance float"))
    w = Window.partitionBy("query_id").orderBy("distance", "RecordID")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "RecordID", score(F.col("distance")).alias("Similarity_Score"), "distance", "rank")


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<float>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull()))


def _nearest_of_many(shared, k: int, metric: str):
    def run(batches):
        best: dict[int, pd.DataFrame] = {}
        for b in batches:
            sizes = b["v"].map(len).to_numpy() if len(b) else np.zeros(0, int)
            for size in np.unique(sizes):
                part = b[sizes == size]
                x, ids = np.stack(part["v"].to_numpy()).astype(np.float32), part["id"].to_numpy(np.int64)
                for place, (q, v) in enumerate(shared.value):
                    if len(v) != size:
                        continue
                    d = distances(x, v, metric)
                    ok = ~np.isnan(d)
                    one = pd.DataFrame({"query_id": q, "RecordID": ids[ok], "distance": d[ok]})
                    if len(one) > k:
                        one = one[one["distance"] <= np.partition(one["distance"].to_numpy(), k - 1)[k - 1]]
                    held = pd.concat([best[place], one], ignore_index=True) if place in best else one
                    best[place] = held.sort_values(["distance", "RecordID"], kind="stable").head(k)
        yield from best.values()

    return run
