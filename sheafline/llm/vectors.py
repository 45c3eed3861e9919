"""Usable vectors and groups of exact copies, shared by clusters and neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_records(df: DataFrame, id_col: str, components: list[str]) -> DataFrame:
    """Distinct (id, x0, x1, ...) of the rows that hold a usable vector.

    Usable means a non-null id and components of which none is null, NaN or
    infinite and not all are zero. Of several different vectors under one id
    the greatest is kept, so an id counts once. All else is ignored.
    """
    xs = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(components)]
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), *xs).where(F.col("id").isNotNull())
    names = [f"x{i}" for i in range(len(components))]
    inf = float("inf")
    fine = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < inf) for c in names])
    some = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in names])
    one = rows.where(fine & some).groupBy("id").agg(F.max(F.struct(*names)).alias("v"))
    return one.select("id", *[(F.col("v").getField(c) + F.lit(0.0)).alias(c) for c in names])


def distinct_vectors(records: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: (vid, x0, ..., n, ids).

    ``vid`` is the smallest id, ``n`` the number of ids and ``ids`` the
    ``keep`` smallest. Spark limits each group before the shuffle, so a vector
    with any number of copies sends at most ``keep`` ids per task.
    """
    names = [c for c in records.columns if c != "id"]
    counts = records.groupBy(*names).agg(F.count("*").alias("n"), F.min("id").alias("vid"))
    if keep <= 1:
        return counts.select("vid", *names, "n", F.array("vid").alias("ids"))
    w = Window.partitionBy(*names).orderBy("id")
    low = records.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep)
    ids = low.groupBy(*names).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return counts.join(ids, names).select("vid", *names, "n", "ids")


def cell(names: list[str], side: float) -> Column:
    """Grid cell as a struct of whole doubles; any finite component has one."""
    return F.struct(*[(F.rint(F.col(c) / F.lit(side)) + F.lit(0.0)).alias(c) for c in names])
