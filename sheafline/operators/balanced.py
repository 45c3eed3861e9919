"""Per-key results without imbalance when a few keys hold most rows.

Rows that tie on (key, order column) are combined where they are read, so that
even a key whose rows all tie is a few rows per task. The rest is range-
partitioned on (key, order) with sampled quantiles, so a heavy key spreads over
as many partitions as it needs. Each partition, sorted, gives one partial state
per key; the states of a key that crosses partition borders are then stitched
in partition order. States are at most one row per key and partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_WHOLE = ("tinyint", "smallint", "int", "bigint")
_HALF = 1 << 32


def per_key(df: DataFrame, key: str, value: str, order: str, partitions: int | None = None) -> DataFrame:
    """(key, n_rows, total, first_order, last_order, max_gap, share) for every key.

    ``total`` sums the non-null values, whole numbers exactly as decimal(38,0),
    others as double. ``order`` is a number, a date (in days) or a timestamp (in
    seconds); NaN counts as null. ``max_gap`` is the widest step between
    neighbours in its order, null where a key has fewer than two non-null
    orders; whole numbers and timestamps are compared exactly, and a step of
    2^63 or more counts as 2^63 - 1. Rows with a null key form the group whose
    key is null. ``share`` is the part of the rows with non-null key and null
    for the null group. Repeated rows count as often as they come. An empty
    table gives no rows.
    """
    kinds = dict(df.dtypes)
    whole, stamp = kinds[value] in _WHOLE, kinds[order].startswith("timestamp")
    unit = 1e6 if stamp else 1.0
    rows = df.select(F.col(f"`{key}`").alias("key"), _order(order, kinds[order]).alias("ord"), *_value(value, whole))
    k = dict(rows.dtypes)["key"]
    state = Window.partitionBy("key").orderBy("pid")
    before = F.max("last_order").over(state.rowsBetween(Window.unboundedPreceding, -1))
    stitched = (
        _ranged(rows, partitions)
        .mapInArrow(_partial_states, f"key {k}, pid int, {_fields(rows)}, first_order {_kind(rows)}, last_order {_kind(rows)}, max_gap {_kind(rows)}")
        .withColumn("gap", F.greatest("max_gap", _step(before, F.col("first_order"), _kind(rows))))
        .groupBy("key")
        .agg(*_sums(whole), F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"), F.max("gap").alias("max_gap"))
    )
    keyed_rows = rows.where("key is not null").count()  # a scan of one column
    keyed = stitched.withColumn("share", F.col("n_rows") / F.lit(float(keyed_rows or 1)))
    nulls = (
        rows.where("key is null")
        .agg(*_sums(whole), F.min("ord").alias("first_order"), F.max("ord").alias("last_order"))
        .where("n_rows > 0")
        .withColumns({"key": F.lit(None).cast(k), "max_gap": F.lit(None).cast(_kind(rows)), "share": F.lit(None).cast("double")})
    )
    out = keyed.unionByName(nulls)
    shown = [(F.col(c) / F.lit(unit)).alias(c) if stamp else F.col(c) for c in ("first_order", "last_order", "max_gap")]
    return out.select("key", "n_rows", "total", *shown, "share")


def heavy_keys(result: DataFrame, share: float) -> DataFrame:
    """The keys of a :func:`per_key` result with at least ``share`` of the rows."""
    return result.where((F.col("share") >= share) & F.col("key").isNotNull())


def _order(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "date":
        return F.unix_date(c).cast("long")
    return c.cast("long") if kind in _WHOLE else F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _value(name: str, whole: bool):
    """n, the number of values and their sum; whole numbers as two halves whose sums cannot overflow."""
    c = F.col(f"`{name}`")
    ones = [F.lit(1).cast("long").alias("n"), c.isNotNull().cast("long").alias("valued")]
    if not whole:
        return [*ones, F.coalesce(c.cast("double"), F.lit(0.0)).alias("a"), F.lit(0.0).alias("b")]
    c = F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return [*ones, F.shiftright(c, 32).alias("a"), c.bitwiseAND(F.lit(_HALF - 1)).alias("b")]


def _kind(rows: DataFrame) -> str:
    return dict(rows.dtypes)["ord"]


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in rows.dtypes if c not in ("key", "ord"))


def _sums(whole: bool):
    exact = "decimal(28,0)"
    total = F.sum(F.col("a").cast(exact)) * F.lit(_HALF).cast("decimal(10,0)") + F.sum(F.col("b").cast(exact)) if whole else F.sum("a")
    total = total.cast("decimal(38,0)") if whole else total
    return [F.sum("n").alias("n_rows"), F.when(F.sum("valued") > 0, total).alias("total")]


def _step(low, high, kind: str):
    """high - low, where high is not below low; beyond the type's range its greatest value."""
    return F.coalesce(F.try_subtract(high, low), F.when(low.isNotNull() & high.isNotNull(), F.lit(2**63 - 1))) if kind == "bigint" else high - low


def _ranged(rows: DataFrame, partitions: int | None) -> DataFrame:
    """Keyed rows, ties combined per batch, in sorted ranges of (key, order)."""
    spark = rows.sparkSession
    parts = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    by = [F.col("key"), F.col("ord").asc_nulls_last()]
    return rows.where("key is not null").mapInArrow(_combined, fields).repartitionByRange(parts, *by).sortWithinPartitions(*by)


def _combined(batches):
    """Rows of a batch that tie on (key, ord) become one; where a row goes depends on these two alone."""
    for b in batches:
        t = pa.Table.from_batches([b])
        sums = t.group_by(["key", "ord"], use_threads=False).aggregate([(c, "sum") for c in t.column_names[2:]])
        t = sums.rename_columns([c.removesuffix("_sum") for c in sums.column_names]).select(t.column_names).cast(t.schema)
        yield from t.combine_chunks().to_batches()


def _partial_states(batches):
    """One state per key of a sorted partition; only a batch's last key is carried over to the next."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    carried = None
    for b in batches:
        if not b.num_rows:
            continue
        states = _states(b, pid)
        if carried is not None:
            if carried.column("key")[0].equals(states.column("key")[0]):
                states = pa.concat_tables([_joined(carried, states.slice(0, 1)), states.slice(1)])
            else:
                states = pa.concat_tables([carried, states])
        carried = states.slice(states.num_rows - 1)
        yield from states.slice(0, states.num_rows - 1).combine_chunks().to_batches()
    if carried is not None:
        yield from carried.combine_chunks().to_batches()


def _states(b: pa.RecordBatch, pid: int) -> pa.Table:
    keys = b.column("key")
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    ends = np.append(starts[1:], len(codes))
    order = b.column("ord")
    real = order.is_valid().to_numpy(zero_copy_only=False)
    x = pc.fill_null(order, 0).to_numpy(zero_copy_only=False)
    seen = np.add.reduceat(real.astype(np.int64), starts)  # nulls come last in their key
    last = x[np.maximum(starts + seen - 1, 0)]
    step = np.zeros(len(x), np.uint64 if x.dtype.kind == "i" else float)
    if x.dtype.kind == "i":  # the difference of sorted numbers fits 64 bits without sign
        step[1:] = np.minimum(x[1:].view(np.uint64) - x[:-1].view(np.uint64), np.uint64(2**63 - 1))
    else:
        step[1:] = np.diff(x)
    inner = real.copy()
    inner[starts] = False
    gap = np.maximum.reduceat(np.where(inner, step, 0), starts).astype(x.dtype)
    out = {"key": keys.take(pa.array(starts)), "pid": pa.array(np.full(len(starts), pid, np.int32))}
    for c in b.schema.names[2:]:
        out[c] = pa.array(np.add.reduceat(b.column(c).to_numpy(zero_copy_only=False), starts))
    many = np.add.reduceat(np.where(real, b.column("n").to_numpy(), 0), starts) > 1  # rows that tie have a gap of 0
    for c, v, ok in (("first_order", x[starts], seen > 0), ("last_order", last, seen > 0), ("max_gap", gap, many)):
        out[c] = pa.array(v, mask=~ok)
    return pa.table(out)


def _joined(a: pa.Table, b: pa.Table) -> pa.Table:
    """Two following states of one key as one."""
    x, y = a.to_pylist()[0], b.to_pylist()[0]
    both = {c: x[c] + y[c] for c in a.column_names if c not in ("key", "pid", "first_order", "last_order", "max_gap")}
    step = None if x["last_order"] is None or y["first_order"] is None else y["first_order"] - x["last_order"]
    gaps = [g for g in (x["max_gap"], y["max_gap"], step) if g is not None]
    first = x["first_order"] if x["first_order"] is not None else y["first_order"]
    last = y["last_order"] if y["last_order"] is not None else x["last_order"]
    gap = max(gaps, default=None)
    gap = min(gap, 2**63 - 1) if isinstance(gap, int) else gap
    rest = both | {"pid": x["pid"], "first_order": first, "last_order": last, "max_gap": gap}
    return pa.table({c: a.column("key") if c == "key" else pa.array([rest[c]], a.schema.field(c).type) for c in a.column_names})
