"""Tables, graphs and matrices from text files, and relations back to files."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..relation import GraphModel, MatrixModel, Relation


class FormatError(ValueError):
    """The file is not what its kind of model needs."""


def read_table(spark: SparkSession, path: str, name: str = "") -> Relation:
    """A CSV file of whole numbers under a header, in file order.

    Blanks in names and around values are dropped; a repeated name, a missing
    or surplus cell and a value that is no whole number are errors.
    """
    header = spark.read.text(path).limit(1).collect()
    if not header:
        raise FormatError("no header")
    names = [re.sub(r"\s", "", c) for c in header[0][0].split(",")]
    if len(set(names)) < len(names) or "" in names:
        raise FormatError("column names must differ")
    df = spark.read.csv(
        path,
        header=True,
        enforceSchema=True,
        schema=", ".join(f"`{c}` int" for c in names),
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        mode="FAILFAST",
    )
    return Relation.of(df, name)


def write_table(rel: Relation, path: str) -> None:
    """One CSV file, header first, cells separated by comma and blank, in order.

    The ordered rows stream through the driver one partition at a time.
    """
    part = f"{path}.part"
    with open(part, "w") as f:
        f.write(", ".join(rel.names) + "\n")
        rows = rel.df.orderBy(*rel.order_by()).select(*[F.col(x.physical).alias(f"v{i}") for i, x in enumerate(rel.fields)])
        for r in rows.toLocalIterator(prefetchPartitions=True):
            f.write(", ".join("" if v is None else str(v) for v in r) + "\n")
    os.replace(part, path)


def write_parquet(rel: Relation, path: str, ordered: bool = False) -> None:
    """A distributed sink for relations of any size."""
    rel.to_df(ordered).write.mode("overwrite").parquet(path)


def graph_paths(folder: str, name: str, directed: bool) -> tuple[str, str]:
    kind = "D" if directed else "U"
    return f"{folder}/{name} Nodes {kind}.csv", f"{folder}/{name} Edges {kind}.csv"


def read_graph(spark: SparkSession, folder: str, name: str, directed: bool) -> GraphModel:
    nodes, edges = graph_paths(folder, name, directed)
    return GraphModel(read_table(spark, nodes, name), read_table(spark, edges, name), directed)


def write_graph(g: GraphModel, folder: str, name: str) -> None:
    nodes, edges = graph_paths(folder, name, g.directed)
    write_table(g.nodes, nodes)
    write_table(g.edges, edges)


def read_matrix(spark: SparkSession, path: str, dimension: int) -> MatrixModel:
    """Lines of comma-separated numbers without header; rows are numbered from 0.

    Missing trailing fields are 0, surplus ones are ignored, so a blank line is
    a zero vector.
    """
    if dimension < 1:
        raise FormatError("a vector has at least one component")
    lines = Relation.of(spark.read.text(path)).numbered("record_id")
    text = F.trim(lines.col("value"))
    cells = F.transform(F.split(text, ","), lambda c: F.when(F.trim(c) == "", F.lit(0.0)).otherwise(F.trim(c).cast("float")).cast("float"))
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(0.0).cast("float"), dimension)), 1, dimension)
    return MatrixModel(lines.df.select("record_id", padded.alias("vec")), dimension)


def matrix_of(df: DataFrame, id_col: str, vec_col: str, dimension: int) -> MatrixModel:
    return MatrixModel(df.select(F.col(f"`{id_col}`").cast("long").alias("record_id"), F.col(f"`{vec_col}`").cast("array<float>").alias("vec")), dimension)
