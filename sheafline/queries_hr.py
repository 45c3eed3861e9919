"""Queries of problems 2, 3 and 6 on the tables of TESTDATA.md, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.balanced import heavy_keys, per_key
from .operators.hierarchy import descendants, hierarchy
from .operators.references import Child, Parent, orphan_counts, orphan_references, with_period
from .runtime import in_force
from .sources.tables import table

#: A key holds too much from this share of its table's keyed rows on.
HOT_SHARE = 0.02


def _tree(spark: SparkSession, d: str, **how) -> DataFrame:
    staff = table(spark, d, "employee").select("ssn", "super_ssn", "loaded_at")
    return hierarchy(in_force(staff, "ssn", "loaded_at"), "ssn", "super_ssn", **how)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, paths=False).select(F.col("node").alias("ssn"), F.col("root").alias("root_ssn"), "depth", "cyclic")


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(
        F.col("node").alias("ssn"), F.col("root").alias("root_ssn"), "depth", "cyclic", F.concat_ws("/", "path").alias("path"), "subtree_size"
    )


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_tree(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    work = table(spark, d, "works_on").select("work_id", "essn", "pno", "work_at")
    return orphan_references(
        [
            Child("works_on.essn", work, "work_id", "essn", "work_at", "employee"),
            Child("works_on.pno", work, "work_id", "pno", "work_at", "project"),
            Child("department.mgr_ssn", table(spark, d, "department"), "dnumber", "mgr_ssn", "loaded_at", "employee"),
        ],
        [
            Parent("employee", table(spark, d, "employee"), "ssn", "loaded_at", "deleted_at"),
            Parent("project", table(spark, d, "project"), "pnumber", "loaded_at", "deleted_at"),
        ],
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return with_period(_orphans(spark, d))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_orphans(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return per_key(table(spark, d, "edges_500_d").select("src_nodeid", "weight", "dest_nodeid"), "src_nodeid", "weight", "dest_nodeid")


def _bookings(spark: SparkSession, d: str) -> DataFrame:
    return per_key(table(spark, d, "works_on").select("pno", "wk_hours", "work_at"), "pno", "wk_hours", "work_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, got in (("edges_500_d", _edges(spark, d)), ("works_on", _bookings(spark, d))):
        hot = heavy_keys(got, HOT_SHARE).select(F.lit(name).alias("tbl"), F.col("key").alias("hot_key"))
        out = hot if out is None else out.unionByName(hot)
    return out


def p6_out_degree(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select(
        F.col("key").alias("src_nodeid"), F.col("n_rows").alias("out_degree"), F.col("total").cast("long").alias("total_weight")
    )


def p6_bookings(spark: SparkSession, d: str) -> DataFrame:
    return _bookings(spark, d).select(
        F.col("key").alias("pno"), F.col("n_rows").alias("bookings"), F.col("total").cast("long").alias("total_hours"), F.round("max_gap").cast("long").alias("longest_gap_s")
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p3_found, p3_counts, p6_found, p6_out_degree, p6_bookings)}

_FORCE = """with recursive force as (select ssn, super_ssn from (select ssn, super_ssn, row_number() over (partition by ssn order by loaded_at desc) k from employee) x where k = 1),
up as (select f.ssn, p.ssn as par from force f left join force p on f.super_ssn = p.ssn),
"""
_WALK = _FORCE + """
walk as (select ssn, ssn as at_ssn, 0 as depth from up where par is null union all select u.ssn, w.at_ssn, w.depth + 1 from walk w join up u on u.par = w.ssn),
lost as (select u.ssn, u.par from up u where not exists (select 1 from walk w where w.ssn = u.ssn)),
reach as (select ssn, par as to_ssn from lost union select r.ssn, l.par from reach r join lost l on r.to_ssn = l.ssn),
ring as (select ssn from reach where ssn = to_ssn),
low as (select r.ssn, min(r.to_ssn) as root_ssn from reach r join ring g on r.to_ssn = g.ssn group by r.ssn),
tail as (select ssn, 0 as depth from ring union all select l.ssn, t.depth + 1 from tail t join lost l on l.par = t.ssn where l.ssn not in (select ssn from ring)),
"""

_LATEST = """with emp as (select ssn, arg_max({'d': deleted_at}, loaded_at).d as gone, min(loaded_at) as came from employee group by ssn),
proj as (select pnumber, arg_max({'d': deleted_at}, loaded_at).d as gone, min(loaded_at) as came from project group by pnumber),
refs as (
 select 'works_on.essn' as ref_field, work_id as ref_id, work_at as t, ssn as hit, gone, came from works_on left join emp on essn = ssn where essn is not null
 union all select 'works_on.pno', work_id, work_at, pnumber, gone, came from works_on left join proj on pno = pnumber where pno is not null
 union all select 'department.mgr_ssn', dnumber, loaded_at, ssn, gone, came from department left join emp on mgr_ssn = ssn where mgr_ssn is not null),
found as (select distinct ref_field, ref_id, reason, strftime(t, '%Y-%m') as period from (
 select *, case when hit is null then 'missing' when gone <= t then 'deleted' when came > t then 'late' end as reason from refs) x where reason is not null)
"""

ORACLE = {
    "p2_found": _WALK
    + """done as (select ssn, at_ssn as root_ssn, depth, 0 as cyclic from walk union all select t.ssn, l.root_ssn, t.depth, 1 from tail t join low l on l.ssn = t.ssn)
select ssn, root_ssn, depth::int as depth, cyclic::int as cyclic from done""",
    "p2_hierarchy": _WALK
    + """line as (select ssn, ssn as root_ssn, 0 as depth, 0 as cyclic, ssn::varchar as path from up where par is null
 union all select g.ssn, l.root_ssn, 0, 1, g.ssn::varchar from ring g join low l on l.ssn = g.ssn
 union all select u.ssn, w.root_ssn, w.depth + 1, w.cyclic, w.path || '/' || u.ssn from line w join up u on u.par = w.ssn where u.ssn not in (select ssn from ring)),
below as (select ssn, ssn as anc from up union all select b.ssn, u.par from below b join up u on u.ssn = b.anc where u.par is not null and b.anc not in (select ssn from ring)),
sizes as (select anc, count(*) as n from below group by anc)
select l.ssn, root_ssn, depth::int as depth, cyclic::int as cyclic, path, n::bigint as subtree_size from line l join sizes s on s.anc = l.ssn""",
    "p2_descendants": _WALK
    + """below as (select par as ancestor, ssn as descendant, 1 as distance from up where par is not null and ssn not in (select ssn from ring)
 union all select u.par, b.descendant, b.distance + 1 from below b join up u on u.ssn = b.ancestor where u.par is not null and b.ancestor not in (select ssn from ring))
select ancestor, descendant, distance::int as distance from below""",
    "p3_found": _LATEST + "select * from found",
    "p3_counts": _LATEST + "select ref_field, reason, period, count(*) as n_refs from found group by all",
    "p6_found": """select 'edges_500_d' as tbl, src_nodeid as hot_key from edges_500_d where src_nodeid is not null group by 2 having count(*) >= 0.02 * (select count(src_nodeid) from edges_500_d)
 union all select 'works_on', pno from works_on where pno is not null group by 2 having count(*) >= 0.02 * (select count(pno) from works_on)""",
    "p6_out_degree": "select src_nodeid, count(*) as out_degree, sum(weight)::bigint as total_weight from edges_500_d group by 1",
    "p6_bookings": """select pno, count(*) as bookings, sum(wk_hours)::bigint as total_hours,
 case when pno is null then null else max(gap)::bigint end as longest_gap_s
 from (select *, epoch(work_at) - lag(epoch(work_at)) over (partition by pno order by work_at) as gap from works_on) x group by pno""",
}
