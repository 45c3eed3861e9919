"""Top N items within every group, skipping row groups by their statistics.

The rows are written once, clustered by (group, score descending) in sampled
ranges, so a huge group spreads over many files. Row groups end where a large
group ends and double in size inside it, so its best rows stand in a small row
group of their own; small groups share row groups. The statistics kept with
each row group then bound each group's N-th score from below: a row group of a
single group with N rows or more vouches for its minimum. Row groups whose
maximum lies strictly below the bound of every group they contain are never
read. Each file's remaining row groups are read in descending maximum score,
and the current N-th scores skip more, of row groups with several groups after
a look at the group column alone. What is left is at most N rows per group and
file; the last selection takes the N best of those.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, stage_path

#: Rows of a large group's first Parquet row group and of those that small groups share; the most rows of any.
HEAD_ROWS, MOST_ROWS = 256, 262_144
_STATS = "file string, rg int, n long, g_lo long, g_hi long, s_lo double, s_hi double"


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int, head_rows: int = HEAD_ROWS, partitions: int | None = None, seen=None) -> DataFrame:
    """(group, score, tie, place): the ``n`` highest scores of every group.

    Of equal scores the smaller ``tie`` comes first; rows equal in all three
    are repeats and count once. ``place`` counts from 1. Rows with a null
    group, score or tie are ignored, as is a NaN score. Smaller groups give
    fewer rows, an empty table none. Group and tie are whole numbers, the
    score any number. Other columns are ignored. ``seen``, a dict, is given
    accumulators of the row groups and rows ``written`` and ``read``.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    rows = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{score}`").alias("s"), F.col(f"`{tie}`").alias("t")).where(
        "g is not null and s is not null and t is not null and not isnan(double(s))"
    )
    rows = rows.distinct()  # else a row group of repeats would vouch for n scores
    kinds = dict(rows.dtypes)
    parts = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    by = [F.col("g"), F.col("s").desc(), F.col("t")]
    clustered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    folder = stage_path(spark, "topn")
    _folder_at(folder)
    stats = cut(clustered.mapInArrow(_writer(folder, max(head_rows, n)), _STATS))
    sure = stats.where((F.col("g_lo") == F.col("g_hi")) & (F.col("n") >= n)).groupBy(F.col("g_lo").alias("__g")).agg(F.max("s_lo").alias("bound"))
    # of a row group with several groups the reader looks at the groups it holds
    bounded = stats.join(sure, (F.col("g_lo") == F.col("__g")) & (F.col("g_lo") == F.col("g_hi")), "left")
    todo = bounded.where("bound is null or s_hi >= bound").groupBy("file").agg(F.collect_list(F.struct("s_hi", "rg", "g_lo", "g_hi", "n")).alias("rgs"))
    counts = {c: spark.sparkContext.accumulator(0) for c in ("groups_read", "rows_read")}
    if seen is not None:
        total = stats.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        seen.update(counts, groups_written=total[0], rows_written=total[1])
    best = todo.mapInPandas(_reader(n, counts), f"g {kinds['g']}, s {kinds['s']}, t {kinds['t']}")
    w = Window.partitionBy("g").orderBy(F.col("s").desc(), "t")
    placed = best.distinct().withColumn("place", F.row_number().over(w).cast("int")).where(F.col("place") <= n)
    return placed.select(F.col("g").alias(group), F.col("s").alias(score), F.col("t").alias(tie), "place")


def _store(uri: str):
    """(file system, path) of the shared folder, on a mounted path or any store pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else "file://" + uri)


def _folder_at(uri: str) -> None:
    store, path = _store(uri)
    store.create_dir(path, recursive=True)


def _open(uri: str):
    import pyarrow.parquet as pq

    store, path = _store(uri)
    return pq.ParquetFile(store.open_input_file(path))


def _writer(folder: str, head: int):
    """Write a sorted partition as one file and report the statistics of its row groups.

    Every attempt of a task writes a file of its own name; only files that a
    finished attempt reports are read.
    """

    def run(batches):
        import pyarrow.parquet as pq

        uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.parquet"
        out, sink, rg = [], None, 0
        for part in _row_groups(batches, head):
            if sink is None:
                store, path = _store(uri)
                sink = pq.ParquetWriter(store.open_output_stream(path), part.schema, compression="zstd")
            sink.write_table(part, row_group_size=part.num_rows)
            g, s = part.column("g").to_numpy(), part.column("s").to_numpy().astype(float)
            out.append((uri, rg, part.num_rows, int(g[0]), int(g[-1]), s.min(), s.max()))
            rg += 1
        if sink is not None:
            sink.close()
            columns = list(zip(*out))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _STATS.split(", ")])

    return run


def _row_groups(batches, head: int):
    """Tables of rows in order: a group of at least ``head`` rows begins a table and
    ends one, its tables doubling from ``head`` up to MOST_ROWS; smaller ones share."""
    held: list[pa.RecordBatch] = []  # rows of small groups, then of the group that is still coming in
    rows, open_rows, size, current = 0, 0, head, None

    def take(first: int):
        nonlocal held, rows
        t = pa.Table.from_batches(held)
        held, rows = t.slice(first).combine_chunks().to_batches(), rows - first
        return t.slice(0, first).combine_chunks()

    for b in batches:
        g = b.column("g").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if i == j:
                continue
            if g[i] != current:
                if rows and (size > head or rows >= head):
                    yield take(rows)
                current, open_rows, size = g[i], 0, head
            held.append(b.slice(i, j - i))
            rows, open_rows = rows + j - i, open_rows + j - i
            while open_rows >= size:
                if rows > open_rows:
                    yield take(rows - open_rows)  # the small groups before it
                yield take(size)
                open_rows, size = open_rows - size, min(2 * size, MOST_ROWS)
    if rows:
        yield take(rows)


def _reader(n: int, counts):
    def run(batches):
        for b in batches:
            for name, rgs in zip(b["file"], b["rgs"]):
                yield _best_of_file(_open(name), sorted(rgs, key=lambda r: (-r["s_hi"], r["rg"])), n, counts)

    return run


def _best_of_file(f, rgs, n: int, counts=None) -> pd.DataFrame:
    """At most n rows per group that lies in the file."""
    kept = pd.DataFrame({"g": [], "s": [], "t": []})
    nth: dict[int, float] = {}  # the n-th score so far of the groups that have n
    for r in rgs:
        held = [r["g_lo"]]
        if r["g_lo"] != r["g_hi"] and r["s_hi"] < max(nth.values(), default=-np.inf):
            held = np.unique(f.read_row_group(int(r["rg"]), columns=["g"]).column("g").to_numpy())
        if r["g_lo"] == r["g_hi"] or len(held) > 1:
            if all(r["s_hi"] < nth.get(int(g), -np.inf) for g in held):
                continue
        if counts:
            counts["groups_read"].add(1)
            counts["rows_read"].add(int(r["n"]))
        one = f.read_row_group(int(r["rg"]), columns=["g", "s", "t"]).to_pandas().drop_duplicates()
        place = one.sort_values(["g", "s", "t"], ascending=[True, False, True], kind="stable").groupby("g", sort=False).cumcount()
        one = one.loc[place[place < n].index]
        kept = one if kept.empty else pd.concat([kept, one], ignore_index=True)
        kept = kept.sort_values(["g", "s", "t"], ascending=[True, False, True], kind="stable").drop_duplicates()
        place = kept.groupby("g", sort=False).cumcount()
        kept = kept[place < n]
        last = kept[place[place < n] == n - 1]
        nth = dict(zip(last["g"].astype(np.int64), last["s"].astype(float)))
    return kept
