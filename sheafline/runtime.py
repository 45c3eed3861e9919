"""Session helpers shared by all operators: lineage cuts and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side is broadcast; it is counted before. At about
#: 50 bytes a row this is some 10 MB per executor, whatever the input's size.
BROADCAST_ROWS = 200_000

#: A key is heavy from this share of the rows on, so there are at most
#: 1 / HEAVY_SHARE heavy keys, which bounds what is broadcast for them.
HEAVY_SHARE = 0.002


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset, and only in local mode, a temporary folder is
    made and remembered; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named is None:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sheafline-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder, drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders written by this process and not yet released.
_staged: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the tables that were written between stages so far.

    Results computed from them must have been written or fetched before.
    Checkpoints are Spark's own to clean (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(conf).delete(path, True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written between stages."""
    path = f"{shared_dir(spark).rstrip('/')}/sheafline-{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key and is cheap to count.

    A right side of at most ``broadcast_rows`` rows is broadcast. Beyond that
    the heavy keys of ``left`` (at most 1 / HEAVY_SHARE of them) are looked up
    in a broadcast of just their rows, and all others by a shuffle, so no task
    gets the rows of one hot key. Column names of the two sides must differ.
    """
    cond = F.col(left_key) == F.col(right_key)
    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return left.join(F.broadcast(right), cond, how)
    total = left.count()
    counts = left.where(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("__hk")).agg(F.count("*").alias("__n"))
    heavy = cut(counts.where(F.col("__n") >= F.lit(max(2.0, HEAVY_SHARE * total))).select("__hk"))
    if heavy.isEmpty():
        return left.join(right, cond, how)
    marked = left.join(F.broadcast(heavy), F.col(left_key) == F.col("__hk"), "left")
    few = right.join(F.broadcast(heavy), F.col(right_key) == F.col("__hk"), "left_semi")
    hot = marked.where(F.col("__hk").isNotNull()).drop("__hk").join(F.broadcast(few), cond, how)
    return marked.where(F.col("__hk").isNull()).drop("__hk").join(right, cond, how).unionByName(hot)


def in_force(df: DataFrame, key: str, version: str) -> DataFrame:
    """Of the rows of one ``key`` the one with the latest ``version``.

    Rows that tie on ``version`` are expected to be equal; if they are not, the
    greatest row by its columns' order is kept, so the result is the same in
    every run. Rows with a null ``version`` rank below all others. One
    aggregate with map-side combine, no window over a key's rows.
    """
    rest = [c for c in df.columns if c not in (key, version)]
    best = F.max(F.struct(F.col(f"`{version}`"), *[F.col(f"`{c}`") for c in rest])).alias("__r")
    got = df.groupBy(F.col(f"`{key}`").alias("__key")).agg(best)
    return got.select(*[F.col("__key").alias(key) if c == key else F.col("__r").getField(c).alias(c) for c in df.columns])
