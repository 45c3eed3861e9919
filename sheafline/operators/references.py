"""References to records that do not exist, per field and period.

Parent and child keys are tagged, put in long form and grouped by parent table
and key; the aggregate combines on the map side, so a hot key costs one row per
task. Keys whose group lacks a parent, or whose references fall outside the
parent's life, are few; only references to those keys are looked up again, by a
broadcast of checked size or else a join that treats heavy keys apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join


@dataclass(frozen=True)
class Child:
    """A referring field: its table and the columns of id, key and time."""

    field: str
    df: DataFrame
    ref_id: str
    key: str
    at: str
    parent: str


@dataclass(frozen=True)
class Parent:
    """A table referred to; of one key the row with the latest ``loaded`` holds."""

    name: str
    df: DataFrame
    key: str
    loaded: str
    deleted: str | None = None


def orphan_references(children: list[Child], parents: list[Parent]) -> DataFrame:
    """Distinct (ref_field, ref_id, reason, at) of references without a valid target.

    ``reason``: ``missing`` if no row of the parent table has the key;
    ``deleted`` if the deletion time of the row in force is at or before the
    reference; ``late`` if the key was first loaded after it; ``deleted`` wins
    where both hold. A null key is no reference. A null reference time can only
    be ``missing``. Repeated rows count once. Empty tables give no rows, an
    empty parent table makes every reference ``missing``.
    """
    refs = None
    tables = {id(c.df): c.df for c in children}
    for k, df in tables.items():  # a table with several referring fields is read once
        fields = [
            F.struct(
                F.lit(c.field).alias("ref_field"),
                F.lit(c.parent).alias("ptable"),
                F.col(f"`{c.key}`").alias("key"),
                F.col(f"`{c.ref_id}`").alias("ref_id"),
                F.col(f"`{c.at}`").alias("at"),
            )
            for c in children
            if id(c.df) == k
        ]
        one = df.select(F.inline(F.array(*fields))).where("key is not null")
        refs = one if refs is None else refs.unionByName(one)
    time = dict(refs.dtypes)["at"]
    long = refs.select("ptable", "key", F.lit(0).alias("is_parent"), "at", F.lit(None).cast(time).alias("loaded"), F.lit(None).cast(time).alias("deleted"))
    for p in parents:
        gone = F.col(f"`{p.deleted}`") if p.deleted else F.lit(None)
        long = long.unionByName(
            p.df.where(F.col(f"`{p.key}`").isNotNull()).select(
                F.lit(p.name).alias("ptable"),
                F.col(f"`{p.key}`").alias("key"),
                F.lit(1).alias("is_parent"),
                F.lit(None).cast(time).alias("at"),
                F.col(f"`{p.loaded}`").cast(time).alias("loaded"),
                gone.cast(time).alias("deleted"),
            )
        )
    groups = long.groupBy("ptable", "key").agg(
        F.max("is_parent").alias("has_parent"),
        F.sum(1 - F.col("is_parent")).alias("n_refs"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.min("loaded").alias("first_loaded"),
        F.max_by("deleted", "loaded").alias("gone_at"),
    )
    suspect = groups.where(
        (F.col("n_refs") > 0)
        & (
            (F.col("has_parent") == 0)
            | F.coalesce(F.col("last_at") >= F.col("gone_at"), F.lit(False))
            | F.coalesce(F.col("first_at") < F.col("first_loaded"), F.lit(False))
        )
    )
    suspect = cut(suspect.select(F.struct("ptable", "key").alias("__pk"), "has_parent", "first_loaded", "gone_at"))
    found = lookup_join(refs.withColumn("__ck", F.struct("ptable", "key")), suspect, "__ck", "__pk", "inner")
    reason = (
        F.when(F.col("has_parent") == 0, "missing")
        .when(F.col("gone_at") <= F.col("at"), "deleted")
        .when(F.col("first_loaded") > F.col("at"), "late")
    )
    return found.withColumn("reason", reason).where("reason is not null").select("ref_field", "ref_id", "reason", "at").distinct()


def with_period(orphans: DataFrame, pattern: str = "yyyy-MM") -> DataFrame:
    """Replace the time of each reference by its ``period``, the month by default."""
    return orphans.select("ref_field", "ref_id", "reason", F.date_format("at", pattern).alias("period")).distinct()


def orphan_counts(orphans: DataFrame, pattern: str = "yyyy-MM") -> DataFrame:
    """Number of orphan references per (ref_field, reason, period)."""
    return with_period(orphans, pattern).groupBy("ref_field", "reason", "period").agg(F.count("*").alias("n_refs"))
