"""Queries that run commands of the language through a session, and their SQL.

Tables come from the driver's folder; files are written by the commands
themselves in a fresh folder of the shared one, which is removed at the end.
"""

from __future__ import annotations

import os
import shutil
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang.session import Session
from .operators import graph, ordering, vector
from .operators.graph import Condition
from .queries import _EDGES, _FOLD, _HIGH, _LOW, _ODD_NODES, _odd, _rel, _relax, _weight
from .relation import GraphModel, Relation
from .runtime import stage_path
from .sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@contextmanager
def _session(spark: SparkSession):
    folder = stage_path(spark, "files").removeprefix("file://")
    os.makedirs(folder)
    try:
        yield Session(spark, folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _run(s: Session, *lines: str) -> list[str]:
    return [s.execute(x) for x in lines]


def _lines(spark: SparkSession, text: str) -> DataFrame:
    """(pos, line) of what commands print."""
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "pos long, line string")


def _suppliers(s: Session, d: str) -> None:
    s.register("S", _rel(s.spark, d, "supplier", "s_suppkey", "s_nationkey", order=["s_suppkey"]))


def _orders(s: Session, d: str) -> None:
    s.register("O", _rel(s.spark, d, "orders", "o_orderkey", "o_custkey", order=["o_orderkey"]))


def _saved(s: Session, d: str) -> list[str]:
    """Suppliers through EXPORT, CLEAR and LOAD."""
    _suppliers(s, d)
    return _run(s, "EXPORT S", "CLEAR S", "LOAD S")


def _out(s: Session, name: str) -> DataFrame:
    return s.tables[name].rel.to_df()


def _listed(rows: str) -> str:
    """SQL for (pos, line) of a query of (k, line) in order of k."""
    return f"select row_number() over (order by k) - 1 as pos, line from ({rows}) listed"


def _fixed(*lines: str) -> str:
    quoted = [line.replace("'", "''") for line in lines]
    return "select * from (values " + ", ".join(f"({i}::bigint, '{x}')" for i, x in enumerate(quoted)) + ") t(pos, line)"


# -- files --------------------------------------------------------------------


@_query("select row_number() over (order by s_suppkey) - 1 as pos, s_suppkey::int as s_suppkey, s_nationkey from supplier")
def lang_load(spark, d):
    with _session(spark) as s:
        _saved(s, d)
        out = s.tables["S"].rel.numbered("pos")
        return out.df.select("pos", *[out.col(c).alias(c) for c in out.names])


@_query(_listed("select -1 as k, 's_suppkey, s_nationkey' as line union all select s_suppkey, s_suppkey || ', ' || s_nationkey from supplier"))
def lang_export(spark, d):
    with _session(spark) as s:
        _suppliers(s, d)
        _run(s, "EXPORT S")
        with open(f"{s.data_dir}/S.csv") as f:
            return _lines(spark, f.read().rstrip("\n"))


@_query(
    _listed(
        "select 0 as k, 'Loaded Table. Column Count: 2 Row Count: ' || count(*) as line from supplier"
        " union all select 1, 's_suppkey, s_nationkey' union all select 1 + row_number() over (order by s_suppkey), s_suppkey || ', ' || s_nationkey from (select * from supplier order by s_suppkey limit 20) x"
        " union all select 98, '' union all select 99, 'Row Count: ' || count(*) from supplier"
    )
)
def lang_print(spark, d):
    with _session(spark) as s:
        said = _saved(s, d)
        return _lines(spark, "\n".join([said[-1], s.execute("PRINT S")]))


_GRAPH_EDGES = "select s_suppkey, s_nationkey as src, s_suppkey % 25 as dst, 1 + s_suppkey % 40 as w, s_suppkey % 2 as b from supplier"


def _graph(s: Session, d: str, directed: bool = True) -> str:
    """Nations as nodes and suppliers as edges, through EXPORT GRAPH and LOAD GRAPH."""
    nodes = table(s.spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") % 2).alias("A1"))
    edges = table(s.spark, d, "supplier").select(
        "s_suppkey",
        F.col("s_nationkey").alias("src"),
        (F.col("s_suppkey") % 25).cast("int").alias("dst"),
        (1 + F.col("s_suppkey") % 40).cast("int").alias("w"),
        (F.col("s_suppkey") % 2).cast("int").alias("B1"),
    )
    edges = Relation.of(edges, "edges", ["s_suppkey"])
    s.graphs["G"] = GraphModel(Relation.of(nodes, "nodes", ["id"]), edges.keep(edges.fields[1:]), directed)
    s.execute("EXPORT GRAPH G")
    del s.graphs["G"]
    return s.execute(f"LOAD GRAPH G {'D' if directed else 'U'}")


@_query("select 'Loaded Graph.Node Count:' || (select count(*) from nation) || ',Edge Count:' || (select count(*) from supplier) as line, 0::bigint as pos")
def lang_load_graph(spark, d):
    with _session(spark) as s:
        return _lines(spark, _graph(s, d, directed=False))


@_query(f"select src::int as src, dst::int as dst, w::int as w, b::int as b1 from ({_GRAPH_EDGES}) e")
def lang_export_graph(spark, d):
    with _session(spark) as s:
        _graph(s, d)
        return s.graphs["G"].edges.to_df().withColumnRenamed("B1", "b1")


@_query(
    _listed(
        f"""select -5 as k, (select count(*) from nation)::varchar as line union all select -4, (select count(*) from supplier)::varchar union all select -3, 'D'
 union all select -2, '' union all select n_nationkey, n_nationkey || ',' || n_regionkey % 2 from nation union all select 1000, ''
 union all select 1001 + s_suppkey, src || ',' || dst || ',' || w || ',' || b from ({_GRAPH_EDGES}) e"""
    )
)
def lang_print_graph(spark, d):
    with _session(spark) as s:
        _graph(s, d)
        return _lines(spark, s.execute("PRINT GRAPH G"))


@_query("select row_number() over (order by vec_id) - 1 as record_id, embedding[1]::double as first, embedding[64]::double as last, len(embedding)::int as n from embeddings")
def lang_load_matrix(spark, d):
    with _session(spark) as s:
        rows = table(spark, d, "embeddings").orderBy("vec_id").select(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","))
        with open(f"{s.data_dir}/M.csv", "w") as f:
            f.writelines(r[0] + "\n" for r in rows.toLocalIterator())
        _run(s, "LOAD VECTOR MATRIX M 64")
        one = lambda i, n: F.get("vec", F.lit(i)).cast("double").alias(n)
        return s.matrices["M"].df.select("record_id", one(0, "first"), one(63, "last"), F.size("vec").alias("n"))


# -- relations ----------------------------------------------------------------


@_query(
    """select n_nationkey, n_regionkey as region, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey >= 5 and n_nationkey <> n_regionkey"""
)
def lang_source(spark, d):
    """A script that calls another one: SELECT, RENAME and JOIN."""
    with _session(spark) as s:
        s.register("N", _rel(spark, d, "nation", "n_nationkey", "n_regionkey", order=["n_nationkey"]))
        s.register("R", _rel(spark, d, "region", order=["r_regionkey"]))
        for name, text in {
            "outer": "SOURCE inner\nB <- SELECT n_nationkey != region FROM A\nJ <- JOIN B R ON B.region == R.r_regionkey PROJECT B.n_nationkey B.region R.r_name\n",
            "inner": "A <- SELECT n_nationkey >= 5 FROM N\nRENAME n_regionkey TO region FROM A\n",
        }.items():
            with open(f"{s.data_dir}/{name}.ra", "w") as f:
                f.write(text)
        _run(s, "SOURCE outer")
        return _out(s, "J")


@_query("select a.s_suppkey::bigint as S1_s_suppkey, a.s_nationkey as S1_s_nationkey, b.s_suppkey::bigint as S2_s_suppkey, b.s_nationkey as S2_s_nationkey from (select * from supplier where s_nationkey < 2) a cross join (select * from supplier where s_nationkey < 2) b")
def lang_cross(spark, d):
    with _session(spark) as s:
        _suppliers(s, d)
        _run(s, "F <- SELECT s_nationkey < 2 FROM S", "CLEAR S", "S <- PROJECT s_suppkey, s_nationkey FROM F", "C <- CROSS S S")
        return _out(s, "C")


@_query("select o_custkey, max(o_orderkey) as MAXo_orderkey from orders group by 1 having count(*) > 3")
def lang_group(spark, d):
    with _session(spark) as s:
        _orders(s, d)
        _run(s, "G <- GROUP BY o_custkey FROM O HAVING COUNT(*) > 3 RETURN MAX(o_orderkey)")
        return _out(s, "G")


@_query("select o_custkey, row_number() over (order by min(o_orderkey)) - 1 as pos from orders group by 1")
def lang_distinct(spark, d):
    with _session(spark) as s:
        _orders(s, d)
        _run(s, "P <- PROJECT o_custkey FROM O", "D <- DISTINCT P")
        out = s.tables["D"].rel.numbered("pos")
        return out.df.select(out.col("o_custkey").alias("o_custkey"), "pos")


_SEGMENT = """with n as (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as ord, (select count(*) from orders) as n from orders)
select o_orderkey, row_number() over (order by case when {inside} then {side} else {middle} end, case when {inside} then {key} end, ord) - 1 as pos from n"""


def _sorted(spark, d, command: str) -> DataFrame:
    with _session(spark) as s:
        _orders(s, d)
        _run(s, command)
        out = s.tables["O"].rel.numbered("pos")
        return out.df.select(out.col("o_orderkey").alias("o_orderkey"), "pos")


@_query(_SEGMENT.format(inside="ord < 500", side=0, middle=1, key="-o_custkey"))
def lang_sort_top(spark, d):
    return _sorted(spark, d, "SORT O BY o_custkey IN DESC TOP 500")


@_query(_SEGMENT.format(inside="ord >= n - 700", side=1, middle=0, key="o_custkey"))
def lang_sort_bottom(spark, d):
    return _sorted(spark, d, "SORT O BY o_custkey IN ASC BOTTOM 700")


@_query("select o_orderkey, row_number() over (order by o_custkey desc, o_orderkey) - 1 as pos from orders")
def lang_sort(spark, d):
    return _sorted(spark, d, "SORT O BY o_custkey IN DESC")


# -- catalogue and settings ---------------------------------------------------


@_query("select 'o_orderkey' as name, count(distinct o_orderkey) as n_distinct from orders union all select 'o_custkey', count(distinct o_custkey) from orders union all select 'o_orderstatus', count(distinct o_orderstatus) from orders union all select 'o_totalprice', count(distinct o_totalprice) from orders")
def distinct_counts(spark, d):
    from .operators.aggregate import distinct_counts as counts

    return counts(_rel(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")).drop("place")


@_query(
    """with n as (select count(*) as n, count(distinct o_orderkey) as a, count(distinct o_custkey) as b from orders)
select unnest(range(0, 10)) as pos, unnest(['', 'DESCRIBE O (TABLE)', 'Model          : Relational Table', 'Columns        : o_orderkey, o_custkey', 'Column Count   : 2',
 'Distinct Values: o_orderkey=' || a || ', o_custkey=' || b, 'Row Count      : ' || n, 'Block Count    : ' || ceil(n / 125.0)::bigint, 'Rows / Block   : 125', 'Indexed        : NO']) as line from n
 union all select 10, 'Persisted      : NO (temporary)'"""
)
def lang_describe(spark, d):
    with _session(spark) as s:
        _orders(s, d)
        return _lines(spark, s.execute("DESCRIBE O"))


@_query(_fixed("", "RELATIONS", "A", "S", "", "Row Count: 2", "", "GRAPHS", "G (U)", "", "Row Count: 1", "", "MATRICES", "", "Row Count: 0"))
def lang_list(spark, d):
    with _session(spark) as s:
        _suppliers(s, d)
        _graph(s, d, directed=False)
        _run(s, "A <- SELECT s_nationkey > 3 FROM S", "B <- PROJECT s_suppkey FROM A", "CLEAR B")
        return _lines(spark, "\n".join(_run(s, "LIST TABLES", "LIST GRAPHS", "LIST MATRICES")))


@_query("select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as pos from orders")
def lang_index(spark, d):
    """Neither kind of index changes rows or their order."""
    with _session(spark) as s:
        _orders(s, d)
        _run(s, "INDEX ON o_custkey FROM O USING BTREE", "INDEX ON o_custkey FROM O USING NOTHING", "A <- PROJECT o_orderkey, o_custkey FROM O", "INDEX ON o_custkey FROM A USING HASH")
        out = s.tables["A"].rel.numbered("pos")
        return out.df.select(*[out.col(c).alias(c) for c in out.names], "pos")


@_query(f"{_FOLD.format(t='region', k='r_regionkey', v='r_regionkey').replace('as checksum, (n - 1) // 5 as n_rows from o', 'as c, (n - 1) // 5 as n from o')}".join(["select unnest([0, 1, 2]::bigint[]) as pos, unnest(['', 'CHECKSUM R : 0x' || c, 'Rows Hashed: ' || n]) as line from (", ") x"]))
def lang_checksum(spark, d):
    with _session(spark) as s:
        s.register("R", _rel(spark, d, "region", "r_regionkey", order=["r_regionkey"]))
        _run(s, "T <- PROJECT r_regionkey, r_regionkey FROM R", "CLEAR R", "R <- PROJECT r_regionkey, r_regionkey FROM T")
        return _lines(spark, s.execute("CHECKSUM R"))


@_query(
    _fixed(
        "SETBUFFER 1 | SEMANTIC ERROR",
        "SETBUFFER 10 | ",
        "SETBUFFER x | SYNTAX ERROR",
        "LOAD nothing | SEMANTIC ERROR: Data file doesn't exist",
        "S <- SELECT s_suppkey > 1 FROM S | SEMANTIC ERROR: Resultant relation already exists",
        "A <- SELECT s_suppkey>1 FROM S | SYNTAX ERROR",
        "A <- SELECT nothing > 1 FROM S | SEMANTIC ERROR: Column doesn't exist in relation",
        "A <- JOIN S S ON S.s_suppkey > S.s_suppkey | SYNTAX ERROR",
        "A <- PROJECT FROM S | SYNTAX ERROR",
        "A <- GROUP BY nothing FROM S HAVING COUNT(*) > 0 RETURN COUNT(*) | SEMANTIC ERROR: Group By column doesn't exist in relation",
        "A <- GROUP BY s_nationkey FROM S HAVING COUNT(*) > 999999 RETURN COUNT(*) | ",
        "PRINT A | SEMANTIC ERROR: Relation doesn't exist",
        "RENAME s_suppkey TO s_nationkey FROM S | SEMANTIC ERROR: Column with name already exists",
        "SORT S BY s_suppkey IN ASC TOP 99999999 | SEMANTIC ERROR",
        "INDEX ON s_suppkey FROM S USING TREE | SYNTAX ERROR",
        "CLEAR A | SEMANTIC ERROR: No such relation exists",
        "DEGREE G 99999 | Node does not exist",
        "P <- PATH G 1 99999 | Node does not exist",
        "R <- KNN M QUERY_VEC [ 1 2 ] TOP 3 METRIC COSINE | Error: Matrix not loaded.",
        "SOURCE nothing | SEMANTIC ERROR: File doesn't exist",
        "TRANSACTION nothing.txt | SEMANTIC ERROR: File doesn't exist",
        "QUIT now | SYNTAX ERROR",
        "QUIT | ",
    )
)
def lang_errors(spark, d):
    with _session(spark) as s:
        _suppliers(s, d)
        _graph(s, d)
        commands = [line.split("'", 1)[1].rsplit("')", 1)[0].replace("''", "'").split(" | ")[0] for line in ORACLE["lang_errors"].split("(values ")[1].rsplit(") t(", 1)[0].split(", (")]
        return _lines(spark, "\n".join(f"{c} | {s.execute(c)}" for c in commands))


@_query("select 0::bigint as pos, 'SYNTAX ERROR' as line union all select 1, 'left: 0'")
def lang_quit(spark, d):
    """Nothing of a script runs after QUIT."""
    with _session(spark) as s:
        _suppliers(s, d)
        with open(f"{s.data_dir}/q.ra", "w") as f:
            f.write("QUITE\nCLEAR S\nQUIT\nS <- SELECT s_suppkey > 0 FROM S\nPRINT S\n")
        said = s.execute("SOURCE q")
        return _lines(spark, f"{said}\nleft: {len(s.tables)}")


# A schedule over the suppliers' blocks: the older one waits, the younger one dies and starts again.
_SCHEDULE = ["BEGIN T1", "BEGIN T2", "READ T1 S 0", "WRITE T2 S 0", "READ T1 none 0", "READ T1 S 99999", "oops", "COMMIT T1", "COMMIT T2"]
_TRACE = [
    "SYNTAX ERROR",
    "BEGIN T1",
    "BEGIN T2",
    "T1 requests shared lock(S 0)",
    "Lock granted",
    "READ T1 S 0",
    "T2 requests exclusive lock(S 0)",
    "T2 dies (younger transaction cannot wait for older)",
    "ABORT T2",
    "ROLLBACK T2",
    "SEMANTIC ERROR: Relation doesn't exist",
    "SEMANTIC ERROR: Page doesn't exist",
    "COMMIT T1",
    "unlock(S 0) by T1",
    "Restart T2",
    "T2 requests exclusive lock(S 0)",
    "Lock granted",
    "WRITE T2 S 0",
    "COMMIT T2",
    "unlock(S 0) by T2",
]


@_query(_fixed(*_TRACE))
def lang_transaction(spark, d):
    with _session(spark) as s:
        _suppliers(s, d)
        with open(f"{s.data_dir}/work.txt", "w") as f:
            f.write("\n".join(_SCHEDULE))
        _run(s, "TRANSACTION work.txt")
        with open(f"{s.data_dir}/work_output.txt") as f:
            return _lines(spark, f.read().rstrip("\n"))


# -- graphs and vectors -------------------------------------------------------


@_query(f"with e as ({_GRAPH_EDGES}) select 0::bigint as pos, ((select count(*) from e where src = 3) + (select count(*) from e where dst = 3))::varchar as line")
def lang_degree(spark, d):
    with _session(spark) as s:
        _graph(s, d)
        return _lines(spark, s.execute("DEGREE G 3"))


@_query(
    f"""with recursive e as ({_GRAPH_EDGES}), g as (select src, dst, w from e where b = 1 union all select dst, src, w from e where b = 1),
d(node, dist) using key (node) as (select 1::bigint, 0::bigint union
 select g.dst, min(d.dist + g.w)::bigint from d join g on g.src = d.node left join recurring.d r on r.node = g.dst where r.node is null or d.dist + g.w < r.dist group by g.dst)
select 0::bigint as pos, coalesce(max('TRUE ' || dist), 'FALSE') as line from d where node = 7"""
)
def lang_path(spark, d):
    with _session(spark) as s:
        _graph(s, d, directed=False)
        return _lines(spark, s.execute("P <- PATH G 1 7 WHERE B1(E)==1"))


@_query(_relax(_ODD_NODES.replace("select g.*", "select g.*") + " where b2 = 0", _LOW, _HIGH))
def path_two_conditions(spark, d):
    return _weight(spark, d, *_odd(spark, d), [Condition(True, "A1", 1), Condition(False, "B2", 0)])


def _least(edges: list[str]) -> str:
    return "select min(dist) as dist from (" + " union all ".join(f"(select * from ({_relax(e, _LOW, _HIGH)}) x)" for e in edges) + ") y having min(dist) is not null"


@_query(_least([f"select * from g where b1 = {v}" for v in (0, 1)]))
def path_open_value(spark, d):
    """B1(E) without a value: one value throughout, whichever is lighter."""
    return _weight(spark, d, *_odd(spark, d), [Condition(False, "B1")])


_SAME = "select g.* from g where src % 2 = {v} and dst % 2 = {v} and {low} % 2 = {v} and {high} % 2 = {v}"


@_query(_least([_ODD_NODES, *[_SAME.format(v=v, low=_LOW, high=_HIGH) for v in (0, 1)]]))
def path_any_node(spark, d):
    """ANY(N): all nodes of odd or even size, or all of odd or even key, as both ends are."""
    return _weight(spark, d, *_odd(spark, d), [Condition(True, None)])


@_query(
    """select q as query_id, RecordID, Similarity_Score, rank::int as rank from (
 select a.vec_id as q, b.vec_id as RecordID, trunc(list_distance(a.embedding, b.embedding) * 10000)::int as Similarity_Score,
  row_number() over (partition by a.vec_id order by list_distance(a.embedding, b.embedding), b.vec_id) as rank
 from (select * from embeddings where vec_id % 50 = 0) a, embeddings b) x where rank <= 5"""
)
def knn_many(spark, d):
    """Every vector whose id is divisible by 50 against all."""
    df = table(spark, d, "embeddings")
    queries = df.where("vec_id % 50 = 0")
    return vector.knn_many(df, "vec_id", "embedding", queries, "vec_id", "embedding", 5, "EUCLIDEAN").drop("distance")
