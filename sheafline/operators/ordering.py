"""Stable sorting of relations, whole or of the first and last rows only."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..relation import Relation


def sort(rel: Relation, keys: list[str], ascending: list[bool]) -> Relation:
    """Stable sort: the keys come before the previous order. No rows move until needed.

    Nulls come first ascending and last descending.
    """
    return replace(rel, order=tuple((rel.field(k).physical, up) for k, up in zip(keys, ascending)) + rel.order)


def sort_segments(rel: Relation, keys: list[str], ascending: list[bool], top: int | None, bottom: int | None) -> Relation:
    """Sort the first ``top`` and the last ``bottom`` rows where they stand.

    All rows remain and those between keep their places. More rows than there
    are, or segments that overlap, raise ValueError.
    """
    if top is None and bottom is None:
        return sort(rel, keys, ascending)
    x, y = top or 0, bottom or 0
    placed = rel.numbered()
    n = placed.df.count()
    if x < 0 or y < 0 or x + y > n:
        raise ValueError("the segments do not fit the rows")
    at = F.col("__ord")
    segment = F.when(at < x, 0).when(at >= n - y, 2).otherwise(1)
    df = placed.df.withColumn("__seg", segment)
    order = [("__seg", True)]
    for i, (k, up) in enumerate(zip(keys, ascending)):
        df = df.withColumn(f"__k{i}", F.when(F.col("__seg") != 1, placed.col(k)))
        order.append((f"__k{i}", up))
    tag = rel.fields[0].physical
    names = ["__seg", *[f"__k{i}" for i in range(len(keys))], "__ord"]
    for c in names:  # names of this sort alone, so that sorts can follow each other
        df = df.withColumnRenamed(c, f"{tag}{c}")
    return Relation(df, placed.fields, tuple((f"{tag}{c}", up) for c, up in [*order, ("__ord", True)]))
