"""Problem 7: the hierarchies of corrections and of record dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.hierarchy import descendants, edges_of, hierarchy, subtree_sizes
from pagelake.sources.tables import table


def record_edges(spark: SparkSession, root: str) -> DataFrame:
    """The parent links of both tables, told apart by ``graph``."""
    c = edges_of(table(spark, root, "correction_records", "correction_id", "supersedes_id"), "correction_id", "supersedes_id", "correction_records")
    d = edges_of(table(spark, root, "record_dependencies", "record_id", "dependency_id"), "record_id", "dependency_id", "record_dependencies")
    return c.unionByName(d)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy(record_edges(spark, root), paths=False).select(F.col("graph").alias("node_table"), "node_id", "root_id", "depth")


def p7_hierarchy(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy(record_edges(spark, root)).withColumnRenamed("graph", "node_table")


def p7_descendants(spark: SparkSession, root: str) -> DataFrame:
    return descendants(record_edges(spark, root)).withColumnRenamed("graph", "node_table")


def p7_subtrees(spark: SparkSession, root: str) -> DataFrame:
    """How many descendants each node has."""
    return subtree_sizes(record_edges(spark, root)).withColumnRenamed("graph", "node_table")


_EDGES = """e as (
  select distinct * from (
    select 'correction_records' as t, trim(correction_id) as c, trim(supersedes_id) as p from correction_records
    union all
    select 'record_dependencies', trim(record_id), trim(dependency_id) from record_dependencies)
  where c <> '' and p <> '')"""
_GOOD = """reach(t, a, b) as (select t, c, p from e union select r.t, r.a, e.p from reach r join e on r.t = e.t and r.b = e.c),
loops as (select distinct t, a as n from reach where a = b),
bad as (select t, n from loops union select r.t, r.a from reach r join loops l on r.t = l.t and r.b = l.n),
good as (select t, c, p from e where not exists (select 1 from bad where bad.t = e.t and bad.n = e.c))"""
SQL = {
    "p7_found": f"""with recursive {_EDGES}, {_GOOD},
up(t, n, a, d) as (select t, c, p, 1 from good union select u.t, u.n, g.p, u.d + 1 from up u join good g on u.t = g.t and u.a = g.c)
select t as node_table, n as node_id, a as root_id, min(d)::int as depth from up
where not exists (select 1 from e where e.t = up.t and e.c = up.a) group by 1, 2, 3
union all select t, n, 'cycle', -1 from bad""",
    "p7_hierarchy": f"""with recursive {_EDGES}, {_GOOD},
up(t, n, a, d, way) as (select t, c, p, 1, p || '/' || c from good
  union select u.t, u.n, g.p, u.d + 1, g.p || '/' || u.way from up u join good g on u.t = g.t and u.a = g.c)
select t as node_table, n as node_id, a as root_id, min(d)::int as depth, arg_min(way, (d, way)) as path from up
where not exists (select 1 from e where e.t = up.t and e.c = up.a) group by 1, 2, 3
union all select t, n, 'cycle', -1, null from bad""",
    "p7_descendants": f"""with recursive {_EDGES},
walk(t, n, d, k) as (select t, p, c, 1 from e where p <> c
  union select w.t, w.n, e.c, w.k + 1 from walk w join e on w.t = e.t and w.d = e.p where w.k < 200 and e.c <> w.n)
select t as node_table, n as node_id, d as descendant_id, min(k)::int as distance from walk group by 1, 2, 3""",
    "p7_subtrees": f"""with recursive {_EDGES},
walk(t, n, d) as (select t, p, c from e where p <> c union select w.t, w.n, e.c from walk w join e on w.t = e.t and w.d = e.p where e.c <> w.n)
select t as node_table, n as node_id, count(*) as subtree from walk group by 1, 2""",
}
QUERIES = {"p7_found": p7_found, "p7_hierarchy": p7_hierarchy, "p7_descendants": p7_descendants, "p7_subtrees": p7_subtrees}
