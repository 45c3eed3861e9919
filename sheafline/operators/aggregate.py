"""Grouped aggregates with HAVING, one independent grouping per key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import ceil_avg
from ..relation import Field, Relation
from .relational import COMPARE

FUNCTIONS = ("MAX", "MIN", "SUM", "COUNT", "AVG")


@dataclass(frozen=True)
class Agg:
    """One aggregate; ``column`` is ``*`` only with COUNT."""

    function: str
    column: str

    @property
    def name(self) -> str:
        return self.function + ("" if self.column == "*" else self.column)


def group_by(rel: Relation, keys: list[str], having: tuple[Agg, str, int | Agg], returns: list[Agg]) -> list[Relation]:
    """For each key by itself the groups that satisfy ``having``, with one aggregate.

    ``keys`` and ``returns`` pair up. Results are ordered by key. AVG is rounded
    up to a whole number; SUM is a bigint for whole numbers. Nulls are ignored
    by the aggregates except COUNT(*), form a group of their own as key, and a
    null aggregate satisfies no HAVING.
    """
    if len(keys) != len(returns):
        raise ValueError("as many keys as aggregates are needed")
    out = []
    for key, ret in zip(keys, returns):
        left, op, right = having
        wanted = {"__h": _expression(rel, left), "__r": _expression(rel, ret)}
        if isinstance(right, Agg):
            wanted["__g"] = _expression(rel, right)
        k = rel.field(key)
        grouped = rel.df.groupBy(k.physical).agg(*[e.alias(n) for n, e in wanted.items()])
        other = F.col("__g") if isinstance(right, Agg) else F.lit(right)
        kept = grouped.where(COMPARE[op](F.col("__h"), other)).select(k.physical, "__r")
        out.append(Relation(kept, (k, Field(ret.name, "__r")), ((k.physical, True),)))
    return out


def distinct_counts(rel: Relation) -> DataFrame:
    """(place, name, n_distinct) for every column, in order; nulls do not count.

    One aggregate over (column, value) pairs with map-side combine, so that no
    task holds the values of a column. An empty relation has 0 everywhere.
    """
    # two hashes of different seeds stand for a value, so columns of all types share one long form
    values = F.array(*[F.struct(F.lit(i).alias("i"), *_hashes(F.col(f.physical))) for i, f in enumerate(rel.fields)])
    pairs = rel.df.select(F.explode(values).alias("p")).where("p.a is not null").select("p.*").distinct()
    counts = pairs.groupBy("i").agg(F.count("*").alias("n"))
    names = rel.df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(rel.fields)], "place int, name string")
    return names.join(counts, F.col("place") == F.col("i"), "left").select("place", "name", F.coalesce("n", F.lit(0)).alias("n_distinct"))


def _hashes(c: Column) -> list[Column]:
    return [F.when(c.isNotNull(), F.xxhash64(c, F.lit(seed))).alias(name) for seed, name in ((1, "a"), (2, "b"))]


def _expression(rel: Relation, agg: Agg) -> Column:
    if agg.column == "*":
        if agg.function != "COUNT":
            raise ValueError("only COUNT takes *")
        return F.count(F.lit(1))
    c = rel.col(agg.column)
    if agg.function == "AVG":
        return ceil_avg(c, whole=dict(rel.df.dtypes)[rel.field(agg.column).physical] in ("tinyint", "smallint", "int", "bigint"))
    return {"MAX": F.max, "MIN": F.min, "SUM": F.sum, "COUNT": F.count}[agg.function](c)
