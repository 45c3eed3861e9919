"""Queries of the problems tagged llm on the tables of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import in_force
from ..sources.tables import table
from .clusters import Clustering, cliques, similarity_clusters, typical_members
from .leakage import WINDOW, leaked_items
from .mixing import Mix, mix_sources
from .neighbors import nearest_neighbours
from .reading import Levels, reading_levels
from .topn import top_n

COMPONENTS = ["c0", "c1", "c2", "c3"]
#: Euclidean distance up to which two vectors are similar.
SIMILAR = 0.3


#: Records of a cluster, at least.
CLUSTER_SIZE = 6


def _clusters(spark: SparkSession, d: str) -> Clustering:
    return similarity_clusters(table(spark, d, "vidva_vectors"), "record_id", COMPONENTS, SIMILAR)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cliques(_clusters(spark, d), CLUSTER_SIZE).select(F.col("id").alias("record_id"), "cluster_id")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return typical_members(_clusters(spark, d), 3)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    staff = in_force(table(spark, d, "employee").select("ssn", "dno", "salary", "loaded_at"), "ssn", "loaded_at")
    return top_n(staff.where("salary > 0"), "dno", "salary", "ssn", 5).select("dno", "ssn", "place")


def _neighbours(spark: SparkSession, d: str, **more) -> DataFrame:
    return nearest_neighbours(table(spark, d, "vidva_vectors"), "record_id", COMPONENTS, k=3, max_distance=SIMILAR, **more)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    got = _neighbours(spark, d)
    return got.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def _leaks(spark: SparkSession, d: str, **more) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_items"), "item_id", "passage", **more)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, edited=False).where(F.col("run") >= WINDOW).select("doc_id", "item_id")


def p7_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Also the edited copies: at least half of the item's words aligned."""
    return _leaks(spark, d).where((F.col("score") >= F.col("item_words")) | (F.col("run") >= WINDOW))


def _mix(spark: SparkSession, d: str, **how) -> Mix:
    return mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"), **how)


def p8_corpus(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).corpus


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares


def p8_shares_short(spark: SparkSession, d: str) -> DataFrame:
    """A larger corpus, of which the sources at their caps may miss 5 % together."""
    return _mix(spark, d, shortfall=0.05).shares


def _levels(spark: SparkSession, d: str) -> Levels:
    return reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "reading_labels"), "doc_id", "rater", "band", min_words=40)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).banded().select("doc_id", "band")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).banded().select("doc_id", "n_words", F.round("level", 3).alias("level"), "band")


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p4_found, p5_found, p7_found, p7_alignments, p8_corpus, p8_shares, p8_shares_short, p9_found, p9_levels)}

_USABLE = """with v as (select distinct record_id as id, c0::double as a, c1::double as b, c2::double as c, c3::double as d from vidva_vectors
 where c0 is not null and c1 is not null and c2 is not null and c3 is not null and not isnan(c0) and not isnan(c1) and not isnan(c2) and not isnan(c3)
 and not (c0 = 0 and c1 = 0 and c2 = 0 and c3 = 0)),
"""

ORACLE = {
    "p4_found": """with force as (select ssn, dno, salary from (select *, row_number() over (partition by ssn order by loaded_at desc) as k from employee) x where k = 1)
select dno, ssn, place::int as place from (select dno, ssn, row_number() over (partition by dno order by salary desc, ssn) as place from force where dno is not null and salary > 0) x where place <= 5""",
    "p7_found": """with a as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents),
b as (select item_id, regexp_extract_all(lower(passage), '[a-z]+') as w from heldout_items),
da as (select doc_id, array_to_string(w[i:i+11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from a) x),
ib as (select item_id, array_to_string(w[i:i+11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from b) x)
select distinct doc_id, item_id from da join ib using (g)""",
    "p5_found": _USABLE
    + """near as (select x.id, y.id as other, sqrt((x.a-y.a)*(x.a-y.a)+(x.b-y.b)*(x.b-y.b)+(x.c-y.c)*(x.c-y.c)+(x.d-y.d)*(x.d-y.d)) as dist
 from v x join v y on y.a between x.a - 0.31 and x.a + 0.31 and x.id <> y.id),
best as (select id, other, row_number() over (partition by id order by dist, other) as k from near where dist <= 0.3)
select distinct least(id, other) as id_a, greatest(id, other) as id_b from best where k <= 3""",
}
