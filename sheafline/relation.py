"""The three data models: ordered relations, attribute graphs, vector matrices.

A relation is a list of rows, so it carries an explicit order key beside its
DataFrame. Display names may repeat (a join of tables that share a name);
physical names are unique, and looking a name up takes the first match. The
order is materialised only where rows are shown, written, numbered or hashed.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import cut

#: Bytes of a block that rows may fill, of tables and of vector matrices.
TABLE_BLOCK, MATRIX_BLOCK, MATRIX_HEADER, CELL = 1000, 1024, 4, 4

_fresh = itertools.count()


@dataclass(frozen=True)
class Field:
    name: str
    physical: str
    origin: str = ""


@dataclass(frozen=True)
class Relation:
    """``order`` is a tuple of (physical column, ascending)."""

    df: DataFrame
    fields: tuple[Field, ...]
    order: tuple[tuple[str, bool], ...]

    @classmethod
    def of(cls, df: DataFrame, name: str = "", order: Sequence[str] | None = None) -> Relation:
        """Wrap a DataFrame. Without ``order`` the rows of one file keep its order;
        of several files, or after a shuffle, the order is Spark's and ``order`` should say which holds."""
        tag = f"c{next(_fresh)}"
        fields = tuple(Field(c, f"{tag}_{i}", name) for i, c in enumerate(df.columns))
        out = [F.col(f"`{f.name}`").alias(f.physical) for f in fields]
        if order is None:
            keys = [F.monotonically_increasing_id().alias(f"{tag}_o0")]
        else:
            keys = [F.col(f"`{c}`").alias(f"{tag}_o{i}") for i, c in enumerate(order)]
        return cls(df.select(*out, *keys), fields, tuple((f"{tag}_o{i}", True) for i in range(len(keys))))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def field(self, name: str) -> Field:
        """The first field of that display name."""
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def col(self, name: str) -> Column:
        return F.col(self.field(name).physical)

    def order_by(self) -> list[Column]:
        return [F.col(c).asc() if up else F.col(c).desc() for c, up in self.order]

    def keep(self, fields: Sequence[Field]) -> Relation:
        """Other fields in another order; the order key stays."""
        need = dict.fromkeys([f.physical for f in fields] + [c for c, _ in self.order])
        return replace(self, df=self.df.select(*need), fields=tuple(fields))

    def renewed(self) -> Relation:
        """The same relation under fresh physical names, for self-joins."""
        tag = f"c{next(_fresh)}"
        physical = dict.fromkeys([f.physical for f in self.fields] + [c for c, _ in self.order])
        new = {p: f"{tag}_{i}" for i, p in enumerate(physical)}
        df = self.df.select(*[F.col(p).alias(q) for p, q in new.items()])
        return Relation(df, tuple(replace(f, physical=new[f.physical]) for f in self.fields), tuple((new[c], up) for c, up in self.order))

    def to_df(self, ordered: bool = False) -> DataFrame:
        """A plain DataFrame; of repeated names the later ones get their table's name before them."""
        df = self.df.orderBy(*self.order_by()) if ordered else self.df
        used: set[str] = set()
        out = []
        for f in self.fields:
            name = f.name if f.name not in used else f"{f.origin}_{f.name}" if f.origin else f.name
            k = 2
            while name in used:
                name, k = f"{f.name}_{k}", k + 1
            used.add(name)
            out.append(F.col(f.physical).alias(name))
        return df.select(*out)

    def numbered(self, name: str = "__ord") -> Relation:
        """The same rows with their 0-based place as the only order key.

        The sorted rows are kept, each partition's rows counted, and the counts'
        running sums added to the place within the partition: no single task
        sees more than its partition, and the driver one count per partition.
        """
        rows = cut(self.df.orderBy(*self.order_by()) if self.order else self.df)
        at = F.monotonically_increasing_id()
        part, place = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
        tagged = rows.select("*", part.alias("__p"), place.alias("__i"))
        counts = sorted((r[0], r[1]) for r in tagged.groupBy("__p").count().collect())
        starts = itertools.accumulate((n for _, n in counts), initial=0)
        offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "__q long, __start long")
        whole = tagged.join(F.broadcast(offsets), F.col("__p") == F.col("__q")).withColumn(name, F.col("__start") + F.col("__i")).drop("__q", "__start")
        drop = {c for c, _ in self.order} - {f.physical for f in self.fields}
        return Relation(whole.drop("__p", "__i", *drop), self.fields, ((name, True),))

    def is_integral(self) -> bool:
        kinds = {f.name: f.dataType for f in self.df.schema}
        return all(isinstance(kinds[f.physical], T.IntegralType) for f in self.fields)


@dataclass(frozen=True)
class GraphModel:
    """Node columns: id, attributes. Edge columns: src, dst, weight, attributes."""

    nodes: Relation
    edges: Relation
    directed: bool

    @property
    def node_attributes(self) -> list[str]:
        return self.nodes.names[1:]

    @property
    def edge_attributes(self) -> list[str]:
        return self.edges.names[3:]

    def plain(self) -> tuple[DataFrame, DataFrame]:
        """Nodes as (id, attributes...) and edges as (src, dst, weight, attributes...)
        for traversal; an undirected graph's edges run both ways."""
        n, e = self.nodes, self.edges
        nodes = n.df.select(F.col(n.fields[0].physical).cast("long").alias("id"), *[F.col(f.physical).alias(f"n_{i}") for i, f in enumerate(n.fields[1:])])
        one = e.df.select(
            *[F.col(e.fields[i].physical).cast("long").alias(c) for i, c in enumerate(("src", "dst", "weight"))],
            *[F.col(f.physical).alias(f"e_{i}") for i, f in enumerate(e.fields[3:])],
        )
        if not self.directed:
            back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *one.columns[2:])
            one = one.unionByName(back)
        return nodes, one


@dataclass(frozen=True)
class MatrixModel:
    """``df`` has record_id bigint (0-based file order) and vec array<float>."""

    df: DataFrame
    dimension: int


def block_geometry(rows: int, columns: int) -> tuple[int, int]:
    """(rows per block, blocks) of a table."""
    per = TABLE_BLOCK // (CELL * columns)
    if per < 1:
        raise ValueError(f"a row of {columns} cells does not fit a block")
    return per, -(-rows // per)


def matrix_geometry(rows: int, dimension: int) -> tuple[int, int]:
    """(rows per block, blocks) of a vector matrix."""
    per = max(1, (MATRIX_BLOCK - MATRIX_HEADER) // (CELL + CELL * dimension))
    return per, -(-rows // per)
