"""A session: three catalogues, commands bound against them, and their output."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, graph, integrity, ordering, relational, vector
from ..operators.schedule import wait_die
from ..relation import GraphModel, MatrixModel, Relation, block_geometry, matrix_geometry
from ..runtime import cut
from ..sources import files
from . import commands as C

#: Rows PRINT shows; buffer sizes that are taken; how deep scripts may call scripts.
SHOWN = 20
BUFFERS = range(2, 11)
MOST_DEPTH = 16


class BindError(Exception):
    """A semantic error; its text is what is printed."""


@dataclass
class Table:
    rel: Relation
    persisted: bool = False
    index: tuple[str, str] | None = None
    rows: int | None = None


def _semantic(text: str = "") -> BindError:
    return BindError("SEMANTIC ERROR" + (f": {text}" if text else ""))


class Session:
    """Run commands over the files of one folder. ``execute`` returns what they print."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark, self.data_dir = spark, data_dir.rstrip("/")
        self.tables: dict[str, Table] = {}
        self.graphs: dict[str, GraphModel] = {}
        self.matrices: dict[str, MatrixModel] = {}
        self.buffer = 10
        self.done = False
        self._depth = 0

    # -- running -------------------------------------------------------------

    def execute(self, line: str) -> str:
        try:
            command = C.parse(line)
        except C.CommandSyntaxError:
            return "SYNTAX ERROR"
        if command is None:
            return ""
        try:
            return getattr(self, "_" + type(command).__name__.lower())(command)
        except BindError as e:
            return str(e)
    def run_script(self, path: str) -> list[str]:
        out = []
        with open(path) as f:
            for line in f:
                if self.done:
                    break
                try:
                    out.append(self.execute(line))
                except files.FormatError as e:
                    out.append(f"FORMAT ERROR: {e}")
                except (PySparkException, Py4JJavaError, ValueError, TypeError, OSError) as e:  # a script goes on after a command that fails
                    said = str(e.java_exception.getMessage() if isinstance(e, Py4JJavaError) else e).splitlines()
                    out.append(f"ERROR: {said[0] if said else type(e).__name__}")
        return out

    def register(self, name: str, rel: Relation, rows: int | None = None) -> None:
        """Add a relation made through the Python API under a name."""
        self.tables[name] = Table(rel, rows=rows)

    # -- lookups -------------------------------------------------------------

    def _table(self, name: str, why: str = "Relation doesn't exist") -> Table:
        if name not in self.tables:
            raise _semantic(why)
        return self.tables[name]

    def _graph(self, name: str) -> GraphModel:
        if name not in self.graphs:
            raise _semantic("Graph doesn't exist")
        return self.graphs[name]

    def _fresh(self, *names: str) -> None:
        if len(set(names)) < len(names) or any(n in self.tables for n in names):
            raise _semantic("Resultant relation already exists")

    def _columns(self, rel: Relation, names, why: str = "Column doesn't exist in relation") -> None:
        if not all(rel.has(n) for n in names):
            raise _semantic(why)

    def _rows(self, t: Table) -> int:
        if t.rows is None:
            t.rows = t.rel.df.count()
        return t.rows

    def _path(self, name: str, why: str = "Data file doesn't exist") -> str:
        path = f"{self.data_dir}/{name}"
        if not os.path.isfile(path):
            raise _semantic(why)
        return path

    # -- sources and sinks ---------------------------------------------------

    def _load(self, c: C.Load) -> str:
        if c.name in self.tables:
            raise _semantic("Relation already exists")
        path = self._path(f"{c.name}.csv")
        rel = files.read_table(self.spark, path, c.name)
        t = Table(replace(rel, df=cut(rel.df)), persisted=True)  # a file may be overwritten by EXPORT later
        self.tables[c.name] = t
        return f"Loaded Table. Column Count: {len(rel.fields)} Row Count: {self._rows(t)}"

    def _loadgraph(self, c: C.LoadGraph) -> str:
        if c.name in self.graphs:
            raise _semantic("Graph already exists")
        for path in files.graph_paths(self.data_dir, c.name, c.directed):
            if not os.path.isfile(path):
                raise _semantic("Data file doesn't exist")
        g = files.read_graph(self.spark, self.data_dir, c.name, c.directed)
        g = GraphModel(replace(g.nodes, df=cut(g.nodes.df)), replace(g.edges, df=cut(g.edges.df)), c.directed)
        self.graphs[c.name] = g
        return f"Loaded Graph.Node Count:{g.nodes.df.count()},Edge Count:{g.edges.df.count()}"

    def _loadmatrix(self, c: C.LoadMatrix) -> str:
        if c.name in self.matrices:
            raise _semantic("Matrix already exists")
        m = files.read_matrix(self.spark, self._path(f"{c.name}.csv"), c.dimension)
        self.matrices[c.name] = m = MatrixModel(cut(m.df), c.dimension)
        rows = m.df.count()
        return f"Loaded Matrix. Block Count: {matrix_geometry(rows, c.dimension)[1]} Row Count: {rows}"

    def _export(self, c: C.Export) -> str:
        t = self._table(c.name, "No such relation exists")
        files.write_table(t.rel, f"{self.data_dir}/{c.name}.csv")
        t.persisted = True
        return ""

    def _exportgraph(self, c: C.ExportGraph) -> str:
        files.write_graph(self._graph(c.name), self.data_dir, c.name)
        return ""

    def _print(self, c: C.Print) -> str:
        t = self._table(c.name)
        return "\n".join([*self._lines(t.rel, SHOWN), "", f"Row Count: {self._rows(t)}"])

    def _printgraph(self, c: C.PrintGraph) -> str:
        g = self._graph(c.name)
        head = [str(g.nodes.df.count()), str(g.edges.df.count()), "D" if g.directed else "U", ""]
        cells = [",".join(map(str, r)) for r in self._cells(g.nodes, None)]
        return "\n".join([*head, *cells, "", *(",".join(map(str, r)) for r in self._cells(g.edges, None))])

    def _cells(self, rel: Relation, limit: int | None):
        df = rel.df.orderBy(*rel.order_by())
        df = (df.limit(limit) if limit else df).select(*[F.col(f.physical).alias(f"v{i}") for i, f in enumerate(rel.fields)])
        return df.collect() if limit else df.toLocalIterator()

    def _lines(self, rel: Relation, limit: int) -> list[str]:
        return [", ".join(rel.names), *(", ".join("" if v is None else str(v) for v in r) for r in self._cells(rel, limit))]

    def _source(self, c: C.Source) -> str:
        path = self._path(f"{c.name}.ra", "File doesn't exist")
        if self._depth >= MOST_DEPTH:
            raise _semantic("Scripts call each other too deeply")
        self._depth += 1
        try:
            return "\n".join(x for x in self.run_script(path) if x)
        finally:
            self._depth -= 1

    # -- relational ----------------------------------------------------------

    def _select(self, c: C.Select) -> str:
        self._fresh(c.target)
        t = self._table(c.table)
        self._columns(t.rel, [c.left, *([c.right] if c.column else [])])
        self.register(c.target, relational.select(t.rel, c.left, c.op, c.right, c.column))
        return ""

    def _project(self, c: C.Project) -> str:
        self._fresh(c.target)
        t = self._table(c.table)
        self._columns(t.rel, c.columns)
        self.register(c.target, relational.project(t.rel, list(c.columns)), t.rows)
        return ""

    def _rename(self, c: C.Rename) -> str:
        t = self._table(c.table)
        self._columns(t.rel, [c.old])
        if t.rel.has(c.new):
            raise _semantic("Column with name already exists")
        t.rel = relational.rename(t.rel, c.old, c.new)
        return ""

    def _cross(self, c: C.Cross) -> str:
        self._fresh(c.target)
        a, b = (self._table(n, "Cross relations don't exist") for n in (c.left, c.right))
        self.register(c.target, relational.cross(a.rel, b.rel, c.left, c.right))
        return ""

    def _join(self, c: C.Join) -> str:
        self._fresh(c.target)
        sides = {n: self._table(n).rel for n in (c.left, c.right)}
        for table, column in [c.on.left, c.on.right, *([c.where[0]] if c.where else []), *(c.columns or ())]:
            if table not in sides or not sides[table].has(column):
                raise _semantic("Column doesn't exist in relation")
        if {c.on.left[0], c.on.right[0]} != set(sides):
            raise _semantic("Column doesn't exist in relation")
        out = relational.join(sides[c.left], sides[c.right], c.left, c.right, c.on, c.where, list(c.columns) if c.columns else None)
        self._keep_unless_empty(c.target, out)
        return ""

    def _keep_unless_empty(self, name: str, rel: Relation) -> None:
        """Empty results of JOIN and GROUP BY are not registered; one row tells, the rest stays lazy."""
        if not rel.df.isEmpty():
            self.register(name, rel)

    def _distinct(self, c: C.Distinct) -> str:
        self._fresh(c.target)
        t = self._table(c.table)
        rel = t.rel if all(up for _, up in t.rel.order) else t.rel.numbered()
        self.register(c.target, relational.distinct(rel))
        return ""

    def _groupby(self, c: C.GroupBy) -> str:
        rel = self._table(c.table).rel
        self._fresh(*c.targets)
        self._columns(rel, c.keys, "Group By column doesn't exist in relation")
        having = [a for a in (c.having[0], c.having[2]) if isinstance(a, aggregate.Agg)]
        self._columns(rel, [a.column for a in having if a.column != "*"], "Having column doesn't exist in relation")
        self._columns(rel, [a.column for a in c.returns if a.column != "*"], "Return column doesn't exist in relation")
        for name, out in zip(c.targets, aggregate.group_by(rel, list(c.keys), c.having, list(c.returns))):
            self._keep_unless_empty(name, out)
        return ""

    def _sort(self, c: C.Sort) -> str:
        t = self._table(c.table)
        self._columns(t.rel, c.keys)
        try:
            t.rel = ordering.sort_segments(t.rel, list(c.keys), list(c.ascending), c.top, c.bottom)
        except ValueError:
            raise _semantic() from None
        return ""

    # -- graphs, vectors, schedules ------------------------------------------

    def _degree(self, c: C.Degree) -> str:
        d = graph.degree(self._graph(c.graph), c.node)
        return "Node does not exist" if d is None else str(d)

    def _pathquery(self, c: C.PathQuery) -> str:
        g = self._graph(c.graph)
        if c.target in self.graphs or c.target in self.tables:
            raise _semantic("Resultant relation already exists")
        if not (graph.has_node(g, c.start) and graph.has_node(g, c.end)):
            return "Node does not exist"
        found = graph.shortest_path(g, c.start, c.end, list(c.conditions))
        if found is None:
            return "FALSE"
        self.graphs[c.target] = path_graph(self.spark, g, found)
        return f"TRUE {found.weight}"

    def _knn(self, c: C.Knn) -> str:
        self._fresh(c.target)
        if c.matrix not in self.matrices:
            return "Error: Matrix not loaded."
        m = self.matrices[c.matrix]
        if len(c.query) != m.dimension:
            return "Error: Query vector dimension mismatch."
        got = cut(vector.knn(m.df, "record_id", "vec", list(c.query), c.k, c.metric))
        rel = Relation.of(got, c.target, ["distance", "RecordID"])
        self.register(c.target, rel.keep(rel.fields[:2]))
        return f"KNN executed successfully. Results stored in {c.target}"

    def _transaction(self, c: C.Transaction) -> str:
        path = self._path(c.file, "File doesn't exist")
        said = []

        def pages(name: str) -> int | None:
            if name in self.tables:
                t = self.tables[name]
                return block_geometry(self._rows(t), len(t.rel.fields))[1]
            if name in self.matrices:
                return matrix_geometry(self.matrices[name].df.count(), self.matrices[name].dimension)[1]
            return None

        with open(path) as f:
            trace = wait_die(f.read().split("\n"), pages)
        said = [line for line in trace if line.startswith("SEMANTIC ERROR")]
        base = c.file[:-4] if c.file.endswith(".txt") else c.file
        with open(f"{self.data_dir}/{base}_output.txt", "w") as f:
            f.writelines(line + "\n" for line in trace)
        return "\n".join(said)

    # -- catalogue and settings ----------------------------------------------

    def _listall(self, c: C.ListAll) -> str:
        if c.kind == "TABLES":
            names, title = sorted(self.tables), "RELATIONS"
        elif c.kind == "GRAPHS":
            names, title = [f"{n} ({'D' if g.directed else 'U'})" for n, g in sorted(self.graphs.items())], "GRAPHS"
        else:
            names, title = [f"{n} [dim={m.dimension}]" for n, m in sorted(self.matrices.items())], "MATRICES"
        return "\n".join(["", title, *names, "", f"Row Count: {len(names)}"])

    def _describe(self, c: C.Describe) -> str:
        out = []
        if c.name in self.tables:
            t = self.tables[c.name]
            per, blocks = block_geometry(self._rows(t), len(t.rel.fields))
            facts = [
                ("Model", "Relational Table"),
                ("Columns", ", ".join(t.rel.names)),
                ("Column Count", len(t.rel.fields)),
                ("Distinct Values", ", ".join(f"{r['name']}={r['n_distinct']}" for r in aggregate.distinct_counts(t.rel).orderBy("place").collect())),
                ("Row Count", self._rows(t)),
                ("Block Count", blocks),
                ("Rows / Block", per),
                ("Indexed", "YES" if t.index else "NO"),
                *([("Index Column", t.index[0]), ("Index Strategy", t.index[1])] if t.index else []),
                ("Persisted", "YES" if t.persisted else "NO (temporary)"),
            ]
            out.append(_sheet(c.name, "TABLE", facts))
        if c.name in self.matrices:
            m = self.matrices[c.name]
            rows = m.df.count()
            per, blocks = matrix_geometry(rows, m.dimension)
            facts = [("Model", "Vector Matrix"), ("Dimension", m.dimension), ("Row Count", rows), ("Block Count", blocks), ("Rows / Block", per)]
            out.append(_sheet(c.name, "VECTOR MATRIX", facts))
        if c.name in self.graphs:
            g = self.graphs[c.name]
            kind = "DIRECTED" if g.directed else "UNDIRECTED"
            facts = [("Model", "Graph"), ("Orientation", kind), ("Node Count", g.nodes.df.count()), ("Edge Count", g.edges.df.count())]
            out.append(_sheet(c.name, "GRAPH", facts))
        if not out:
            raise _semantic("Relation doesn't exist")
        return "\n".join(out)

    def _checksum(self, c: C.Checksum) -> str:
        digits, rows = integrity.checksum(self._table(c.name).rel)
        return f"\nCHECKSUM {c.name} : 0x{digits}\nRows Hashed: {rows}"

    def _index(self, c: C.Index) -> str:
        """A hint for the physical layout; results never change."""
        t = self._table(c.table)
        self._columns(t.rel, [c.column])
        if t.index:
            raise _semantic("Table already indexed")
        if c.strategy != "NOTHING":
            key = t.rel.col(c.column)
            df = t.rel.df.repartitionByRange(key).sortWithinPartitions(key) if c.strategy == "BTREE" else t.rel.df.repartition(key)
            t.rel, t.index = replace(t.rel, df=cut(df)), (c.column, c.strategy)
        return ""

    def _clear(self, c: C.Clear) -> str:
        self._table(c.name, "No such relation exists")
        del self.tables[c.name]
        return ""

    def _setbuffer(self, c: C.SetBuffer) -> str:
        """The size is kept and shown; Spark sizes its shuffles itself, so results and other users are not touched."""
        if c.size not in BUFFERS:
            raise _semantic()
        self.buffer = c.size
        return ""

    def _quit(self, c: C.Quit) -> str:
        self.done = True
        return ""


def _sheet(name: str, kind: str, facts: list[tuple]) -> str:
    return "\n".join(["", f"DESCRIBE {name} ({kind})", *(f"{k:<15}: {v}" for k, v in facts)])


def path_graph(spark: SparkSession, g: GraphModel, p: graph.Path) -> GraphModel:
    """The nodes and edges of a path, in path order, with all their attributes."""
    n, e = g.nodes, g.edges
    step = "__step"
    at = spark.createDataFrame([(i, v) for i, v in enumerate(p.nodes)], f"{step} long, __v long")
    nodes = n.df.join(F.broadcast(at), F.col(n.fields[0].physical) == F.col("__v")).drop("__v").dropDuplicates([step])
    nodes = Relation(nodes, n.fields, ((step, True),))
    walked = spark.createDataFrame([(i, *x) for i, x in enumerate(p.edges)], f"{step} long, __s long, __d long, __w long")
    src, dst, weight = (F.col(e.fields[i].physical) for i in range(3))
    along = (src == F.col("__s")) & (dst == F.col("__d"))
    if not g.directed:
        along = along | ((src == F.col("__d")) & (dst == F.col("__s")))
    edges = e.df.join(F.broadcast(walked), along & (weight == F.col("__w"))).drop("__s", "__d", "__w").dropDuplicates([step])
    return GraphModel(replace(nodes, df=cut(nodes.df)), Relation(cut(edges), e.fields, ((step, True),)), g.directed)
