"""One query per operator of the command language, over the driver's tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import aggregate, graph, integrity, ordering, relational, schedule, vector
from .operators.aggregate import Agg
from .operators.graph import Condition
from .operators.relational import On
from .relation import GraphModel, MatrixModel, Relation, block_geometry, matrix_geometry
from .sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def _rel(spark: SparkSession, d: str, name: str, *columns: str, order: list[str] | None = None) -> Relation:
    df = table(spark, d, name)
    return Relation.of(df.select(*columns) if columns else df, name, order)


# -- selection, projection, renaming ------------------------------------------


@_query("select * from lineitem where l_quantity > 30")
def select_literal(spark, d):
    return relational.select(_rel(spark, d, "lineitem"), "l_quantity", ">", 30).to_df()


@_query("select * from lineitem where l_partkey > l_suppkey")
def select_column(spark, d):
    return relational.select(_rel(spark, d, "lineitem"), "l_partkey", ">", "l_suppkey", column=True).to_df()


for _op, _sign in {"lt": "<", "le": "<=", "eq": "==", "ne": "!=", "ge": ">="}.items():
    _query(f"select p_partkey, p_size from part where p_size {_sign} 25", f"select_{_op}")(
        lambda spark, d, s=_sign: relational.select(_rel(spark, d, "part", "p_partkey", "p_size"), "p_size", s, 25).to_df()
    )


@_query("select * from (select p_partkey, p_size from part where p_size >= 10) x where p_size <= 20")
def select_chained(spark, d):
    rel = relational.select(_rel(spark, d, "part", "p_partkey", "p_size"), "p_size", "=>", 10)
    return relational.select(rel, "p_size", "=<", 20).to_df()


@_query("select c_mktsegment, c_custkey from customer")
def project(spark, d):
    return relational.project(_rel(spark, d, "customer"), ["c_mktsegment", "c_custkey"]).to_df()


@_query("select l_returnflag, l_linestatus from lineitem")
def project_dup_rows(spark, d):
    return relational.project(_rel(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).to_df()


@_query("select n_nationkey, n_name as nation_name, n_regionkey from nation")
def rename(spark, d):
    return relational.rename(_rel(spark, d, "nation"), "n_name", "nation_name").to_df()


# -- products and joins -------------------------------------------------------


@_query("select n.*, r.* from nation n cross join region r")
def cross(spark, d):
    return relational.cross(_rel(spark, d, "nation"), _rel(spark, d, "region"), "nation", "region").to_df()


@_query(
    "select a.r_regionkey as region1_r_regionkey, a.r_name as region1_r_name, b.r_regionkey as region2_r_regionkey, b.r_name as region2_r_name"
    " from region a cross join region b"
)
def cross_self(spark, d):
    rel = _rel(spark, d, "region")
    return relational.cross(rel, rel, "region", "region").to_df()


@_query("select c_custkey, c_nationkey, o_orderkey, o_custkey, o_totalprice from customer join orders on c_custkey = o_custkey")
def join_eq(spark, d):
    c, o = _rel(spark, d, "customer", "c_custkey", "c_nationkey"), _rel(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return relational.join(c, o, "customer", "orders", On(("customer", "c_custkey"), ("orders", "o_custkey"))).to_df()


@_query("select o_orderkey, c_mktsegment, o_orderpriority from customer join orders on c_custkey = o_custkey where o_totalprice > 200000")
def join_eq_where_project(spark, d):
    on = On(("customer", "c_custkey"), ("orders", "o_custkey"))
    columns = [("orders", "o_orderkey"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority")]
    return relational.join(
        _rel(spark, d, "customer"), _rel(spark, d, "orders"), "customer", "orders", on, (("orders", "o_totalprice"), ">", 200000), columns
    ).to_df()


@_query("select a.n_nationkey, a.n_regionkey, b.n_nationkey as nation_n_nationkey, b.n_regionkey as nation_n_regionkey from nation a join nation b on a.n_nationkey = b.n_regionkey")
def join_self(spark, d):
    n = _rel(spark, d, "nation", "n_nationkey", "n_regionkey")
    return relational.join(n, n, "nation", "nation", On(("nation", "n_nationkey"), ("nation", "n_regionkey"))).to_df()


@_query("select s_suppkey, s_nationkey, n_nationkey from supplier join nation on s_nationkey + n_nationkey = 20")
def join_arith_plus(spark, d):
    s, n = _rel(spark, d, "supplier", "s_suppkey", "s_nationkey"), _rel(spark, d, "nation", "n_nationkey")
    return relational.join(s, n, "supplier", "nation", On(("supplier", "s_nationkey"), ("nation", "n_nationkey"), "+", 20)).to_df()


@_query("select p_partkey, p_size, n_nationkey from part join nation on p_size - n_nationkey = 3")
def join_arith_minus(spark, d):
    p, n = _rel(spark, d, "part", "p_partkey", "p_size"), _rel(spark, d, "nation", "n_nationkey")
    return relational.join(p, n, "part", "nation", On(("part", "p_size"), ("nation", "n_nationkey"), "-", 3)).to_df()


@_query("select p_partkey, p_size, n_nationkey from part join nation on n_nationkey - p_size = 3")
def join_arith_minus_swapped(spark, d):
    p, n = _rel(spark, d, "part", "p_partkey", "p_size"), _rel(spark, d, "nation", "n_nationkey")
    return relational.join(p, n, "part", "nation", On(("nation", "n_nationkey"), ("part", "p_size"), "-", 3)).to_df()


@_query("select e.ssn, e.salary, d.mgr_ssn from employee e join department d on e.dno = d.dnumber where e.salary > 30000")
def join_employee_department(spark, d):
    e, p = _rel(spark, d, "employee"), _rel(spark, d, "department")
    on = On(("employee", "dno"), ("department", "dnumber"))
    columns = [("employee", "ssn"), ("employee", "salary"), ("department", "mgr_ssn")]
    return relational.join(e, p, "employee", "department", on, (("employee", "salary"), ">", 30000), columns).to_df()


@_query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct(spark, d):
    return relational.distinct(_rel(spark, d, "lineitem", "l_returnflag", "l_linestatus")).to_df()


@_query("select o_orderpriority, row_number() over (order by min(o_orderkey)) - 1 as pos from orders group by 1")
def distinct_first_order(spark, d):
    rel = _rel(spark, d, "orders", "o_orderpriority", "o_orderkey", order=["o_orderkey"])
    out = relational.distinct(relational.project(rel, ["o_orderpriority"])).numbered("pos")
    return out.df.select(out.col("o_orderpriority").alias("o_orderpriority"), "pos")


# -- aggregates ---------------------------------------------------------------

_MANY = (Agg("COUNT", "*"), ">", 1)


def _grouped(spark, d, ret: Agg, having=_MANY) -> DataFrame:
    return aggregate.group_by(_rel(spark, d, "customer", "c_nationkey", "c_custkey"), ["c_nationkey"], having, [ret])[0].to_df()


for _f in ("MAX", "MIN", "SUM", "COUNT"):
    _query(f"select c_nationkey, {_f.lower()}(c_custkey)::bigint as {_f}c_custkey from customer group by 1 having count(*) > 1", f"group_{_f.lower()}")(
        lambda spark, d, f=_f: _grouped(spark, d, Agg(f, "c_custkey"))
    )


@_query("select c_nationkey, count(*) as COUNT from customer group by 1 having count(*) > 1")
def group_count_star(spark, d):
    return _grouped(spark, d, Agg("COUNT", "*"))


@_query(
    "select c_nationkey, (sum(c_custkey) // count(*) + case when sum(c_custkey) % count(*) > 0 then 1 else 0 end)::bigint as AVGc_custkey"
    " from customer group by 1 having count(*) > 1"
)
def group_avg_ceil(spark, d):
    return _grouped(spark, d, Agg("AVG", "c_custkey"))


@_query(
    "select l_suppkey, max(l_partkey) as MAXl_partkey from lineitem group by 1"
    " having sum(l_partkey) // count(*) + case when sum(l_partkey) % count(*) > 0 then 1 else 0 end > min(l_orderkey)"
)
def group_having_agg(spark, d):
    rel = _rel(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_orderkey")
    return aggregate.group_by(rel, ["l_suppkey"], (Agg("AVG", "l_partkey"), ">", Agg("MIN", "l_orderkey")), [Agg("MAX", "l_partkey")])[0].to_df()


def _two_groupings(spark, d):
    rel = _rel(spark, d, "employee", "dno", "sex", "salary", "super_ssn")
    return aggregate.group_by(rel, ["dno", "sex"], (Agg("AVG", "salary"), ">", 30000), [Agg("MAX", "salary"), Agg("COUNT", "*")])


_HAVING = "having ceil(sum(salary)::decimal(38,0) / count(salary)) > 30000"


@_query(f"select dno, max(salary) as MAXsalary from employee group by 1 {_HAVING}")
def group_multi_1(spark, d):
    return _two_groupings(spark, d)[0].to_df()


@_query(f"select sex, count(*) as COUNT from employee group by 1 {_HAVING}")
def group_multi_2(spark, d):
    return _two_groupings(spark, d)[1].to_df()


# -- order --------------------------------------------------------------------


@_query("select o_orderkey, row_number() over (order by o_orderpriority desc, o_custkey, o_orderkey) - 1 as pos from orders")
def sort_multi(spark, d):
    rel = _rel(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_custkey", order=["o_orderkey"])
    out = ordering.sort(rel, ["o_orderpriority", "o_custkey"], [False, True]).numbered("pos")
    return out.df.select(out.col("o_orderkey").alias("o_orderkey"), "pos")


@_query(
    """with n as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as ord, (select count(*) from orders) as n from orders),
s as (select *, case when ord < 100 then 0 when ord >= n - 50 then 2 else 1 end as seg from n)
select o_orderkey, row_number() over (order by seg, case when seg <> 1 then -o_totalprice end, ord) - 1 as pos from s"""
)
def sort_top_bottom(spark, d):
    rel = _rel(spark, d, "orders", "o_orderkey", "o_totalprice", order=["o_orderkey"])
    out = ordering.sort_segments(rel, ["o_totalprice"], [False], 100, 50).numbered("pos")
    return out.df.select(out.col("o_orderkey").alias("o_orderkey"), "pos")


@_query("select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def print_head(spark, d):
    rel = ordering.sort(_rel(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", order=["o_orderkey"]), ["o_totalprice"], [False])
    return rel.to_df(ordered=True).limit(20)


_FOLD = """with r as (select row_number() over (order by {k}) - 1 as i, {k}::bigint as a, {v}::bigint as b from {t}),
 v as (select [2::bigint] || flatten(list([i, 0, a, 1, b] order by i)) as vals from r),
 o as (select flatten(list_transform(vals, lambda x: list_transform(range(0, 8), lambda k: ((x >> (8 * k)::int) & 255)::hugeint))) as bs, len(vals) as n from v)
select upper(printf('%016x', list_reduce([1469598103934665603::hugeint] || bs,
       lambda s, x: (xor(s, x) * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint)) as checksum, (n - 1) // 5 as n_rows from o"""


def _checksum(spark, d, name, k, v) -> DataFrame:
    rel = _rel(spark, d, name, k, v, order=[k])
    return spark.createDataFrame([integrity.checksum(rel)], "checksum string, n_rows long")


@_query(_FOLD.format(t="nation", k="n_nationkey", v="n_regionkey"))
def checksum(spark, d):
    return _checksum(spark, d, "nation", "n_nationkey", "n_regionkey")


@_query(_FOLD.format(t="orders", k="o_orderkey", v="o_custkey"))
def checksum_orders(spark, d):
    return _checksum(spark, d, "orders", "o_orderkey", "o_custkey")


# -- graphs -------------------------------------------------------------------


def _graph(spark, d, directed: bool = True) -> GraphModel:
    part = table(spark, d, "part")
    n = part.count()
    nodes = part.select("p_partkey", (F.col("p_size") % 2).alias("A1"), (F.col("p_partkey") % 2).alias("A2"))
    edges = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("src"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % n).alias("dst"),
        F.col("l_quantity").cast("int").alias("weight"),
        (F.col("l_linenumber") % 2).alias("B1"),
        (F.col("l_returnflag") == "N").cast("int").alias("B2"),
    )
    return GraphModel(Relation.of(nodes, "nodes", ["p_partkey"]), Relation.of(edges, "edges"), directed)


_EDGES = """select l_partkey as src, (l_partkey * 7 + l_suppkey) % (select count(*) from part) as dst, l_quantity::int as w,
 l_linenumber % 2 as b1, (l_returnflag = 'N')::int as b2 from lineitem"""
_DEGREES = f"""with e as ({_EDGES}), ends as (select src as v from e union all select dst from e)
select p_partkey as node, count(v) as degree from part left join ends on v = p_partkey group by 1"""


@_query(_DEGREES)
def degree_directed(spark, d):
    return graph.degrees(_graph(spark, d))


@_query(_DEGREES)
def degree_undirected(spark, d):
    return graph.degrees(_graph(spark, d, directed=False))


@_query(
    """with e as (select src_nodeid as v from edges_500_d union all select dest_nodeid from edges_500_d)
select n.nodeid as node, count(v) as degree from (select distinct nodeid from nodes_500_d) n left join e on v = n.nodeid group by 1"""
)
def degree_500(spark, d):
    nodes, edges = table(spark, d, "nodes_500_d"), table(spark, d, "edges_500_d")
    return graph.degrees(GraphModel(Relation.of(nodes, "nodes"), Relation.of(edges, "edges"), True))


#: Start and end of the paths: the least and greatest part of odd size.
_ODD = "(select {f}(p_partkey) from part where p_size % 2 = 1)"


def _relax(edges: str, start: str, end: str) -> str:
    return f"""with recursive g as ({_EDGES}), e as ({edges}),
d(node, dist) using key (node) as (
 select {start}, 0::bigint
 union
 select e.dst, min(d.dist + e.w)::bigint from d join e on e.src = d.node left join recurring.d r on r.node = e.dst
 where r.node is null or d.dist + e.w < r.dist group by e.dst)
select dist from d where node = {end}"""


def _odd(spark, d) -> tuple[int, int]:
    r = table(spark, d, "part").where("p_size % 2 = 1").agg(F.min("p_partkey"), F.max("p_partkey")).first()
    return r[0], r[1]


def _weight(spark, d, start: int, end: int, conditions=(), **how) -> DataFrame:
    p = graph.shortest_path(_graph(spark, d), start, end, list(conditions), **how)
    return spark.createDataFrame([] if p is None else [(p.weight,)], "dist long")


@_query(_relax("select * from g", "0::bigint", "1234 % (select count(*) from part)"))
def path_weight(spark, d):
    return _weight(spark, d, 0, 1234 % table(spark, d, "part").count())


@_query(_relax("select * from g", "0::bigint", "1234 % (select count(*) from part)"))
def path_weight_joins(spark, d):
    """The same by frontier joins, as for graphs too large for the driver."""
    return _weight(spark, d, 0, 1234 % table(spark, d, "part").count(), local_edges=0)


_LOW, _HIGH = _ODD.format(f="min"), _ODD.format(f="max")
_ODD_NODES = "select g.* from g join part x on x.p_partkey = src and x.p_size % 2 = 1 join part y on y.p_partkey = dst and y.p_size % 2 = 1"


@_query(_relax(_ODD_NODES, _LOW, _HIGH))
def path_node_cond(spark, d):
    return _weight(spark, d, *_odd(spark, d), [Condition(True, "A1", 1)])


@_query(_relax("select * from g where b2 = 0", _LOW, _HIGH))
def path_edge_cond(spark, d):
    return _weight(spark, d, *_odd(spark, d), [Condition(False, "B2", 0)])


@_query(
    "select min(dist) as dist from ("
    + " union all ".join(f"(select * from ({_relax(f'select * from g where {b} = {v}', _LOW, _HIGH)}) x)" for b in ("b1", "b2") for v in (0, 1))
    + ") y having min(dist) is not null"
)
def path_any(spark, d):
    return _weight(spark, d, *_odd(spark, d), [Condition(False, None)])


# -- vectors ------------------------------------------------------------------

_DISTANCE = {
    "manhattan": "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: abs(p[1] - p[2])))",
    "euclidean": "list_distance(e.embedding, q.embedding)",
    "cosine": "list_cosine_distance(e.embedding, q.embedding)",
}


def _knn(spark, d, metric: str) -> DataFrame:
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    query = df.where("vec_id = 7").first()["embedding"]
    return vector.knn(df, "vec_id", "embedding", query, 10, metric.upper()).drop("distance")


for _m, _x in _DISTANCE.items():
    _query(
        f"select vec_id as RecordID, trunc(dist * 10000)::int as Similarity_Score from (select e.vec_id, {_x} as dist from embeddings e,"
        " (select embedding from embeddings where vec_id = 7) q) x order by dist, vec_id limit 10",
        f"knn_{_m}",
    )(lambda spark, d, m=_m: _knn(spark, d, m))


# -- catalogue and schedules --------------------------------------------------

_SHAPES = {"customer": 5, "orders": 6, "part": 6, "lineitem": 11, "employee": 8, "works_on": 6}


@_query(
    " union all ".join(
        f"select '{t}' as tbl, {c} as n_columns, count(*) as n_rows, {1000 // (4 * c)} as rows_per_block, ceil(count(*) / {1000 // (4 * c)}.0)::bigint as n_blocks from {t}"
        for t, c in _SHAPES.items()
    )
)
def describe_geometry(spark, d):
    out = []
    for name in _SHAPES:
        df = table(spark, d, name)
        rows = df.count()
        out.append((name, len(df.columns), rows, *block_geometry(rows, len(df.columns))))
    return spark.createDataFrame(out, "tbl string, n_columns int, n_rows long, rows_per_block int, n_blocks long")


@_query("select 64 as dimension, count(*) as n_rows, 3 as rows_per_block, ceil(count(*) / 3.0)::bigint as n_blocks from embeddings")
def describe_matrix(spark, d):
    m = MatrixModel(table(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vec")), 64)
    rows = m.df.count()
    return spark.createDataFrame([(64, rows, *matrix_geometry(rows, 64))], "dimension int, n_rows long, rows_per_block int, n_blocks long")


@_query()
def schedule_replay(spark, d):
    """A schedule for each 64th of the users: their events read or write pages."""
    e = table(spark, d, "events").select((F.col("user_id") % 64).alias("schedule"), "event_id", "user_id", "value")
    tx = F.concat(F.lit("T"), F.floor(F.col("user_id") / 64) % 6)
    kind = F.when(F.col("event_id") % 3 == 0, "WRITE").otherwise("READ")
    work = e.select("schedule", F.col("event_id").alias("pos"), F.concat_ws(" ", kind, tx, F.lit("pages"), F.col("event_id") % 8).alias("line"))
    ends = e.groupBy("schedule", tx.alias("tx")).agg(F.max("event_id").alias("last"))
    begins = ends.select("schedule", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("BEGIN "), "tx").alias("line"))
    commits = ends.select("schedule", F.col("last").alias("pos"), F.concat(F.lit("COMMIT "), "tx").alias("line"))
    lines = begins.unionByName(work).unionByName(commits)
    place = F.row_number().over(Window.partitionBy("schedule").orderBy("pos", "line"))
    listed = lines.select("schedule", place.alias("pos"), "line")
    return schedule.replay_schedules(listed, "schedule", "pos", "line", {"pages": 8})


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return join_eq_where_project(spark, d)
