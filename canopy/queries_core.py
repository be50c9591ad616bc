"""Queries and SQL of the general data problems: hierarchies (p1) and orphan references (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import hierarchy, orphans
from canopy.session import cut, table

RECORD = ["node_id as id", "created_at", "deleted_at"]


def records(spark: SparkSession, d: str) -> DataFrame:
    """All nodes, those of the graph and the shared ones."""
    return table(spark, d, "graph_node").selectExpr(*RECORD).unionAll(table(spark, d, "shared_node").selectExpr(*RECORD))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.find_cycles(hierarchy.hierarchy_edges(table(spark, d, "graph_relationship"))).select("hierarchy", "cycle_id", "node_id")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy_edges(table(spark, d, "graph_relationship"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(_edges(spark, d))
    return hierarchy.hierarchy_report(hierarchy.resolve_paths(edges), hierarchy.all_descendants(edges))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.all_descendants(_edges(spark, d))


def p1_roots(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.all_roots(_edges(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.direct_orphans(orphans.edge_references(table(spark, d, "graph_relationship")), records(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("rel_id", "endpoint", "reason").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_format("at", "yyyy-MM")
    rows = _orphans(spark, d).select(F.lit("graph_relationship").alias("origin"), "type", "endpoint", month.alias("month"), "reason", "rel_id")
    return rows.groupBy("origin", "type", "endpoint", "month", "reason").agg(F.count("*").alias("n_references"), F.countDistinct("rel_id").alias("n_edges"))


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.cascade_over_graph(table(spark, d, "graph_relationship"), records(spark, d))
    return found.select("hierarchy", "node_id", "level", F.when(F.col("level") == 0, "direct").otherwise("inherited").alias("kind"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_roots, p4_found, p4_report, p4_cascade)}

_EDGES = """
edges as (
  select distinct case when t in ('INHERITS','IMPLEMENTS') then 'inheritance' else 'containment' end as hierarchy,
    case when t in ('INHERITS','IMPLEMENTS') then from_id else to_id end as child,
    case when t in ('INHERITS','IMPLEMENTS') then to_id else from_id end as parent
  from (select *, upper(trim(type, ' ' || chr(9) || chr(10) || chr(13))) as t from graph_relationship) r
  where from_id is not null and to_id is not null
    and t in ('INHERITS','IMPLEMENTS','CONTAINS_PACKAGE','CONTAINS_FOLDER','CONTAINS_FILE','CONTAINS_MODULE','DEFINES','DEFINES_METHOD'))
"""
_CYCLES = f"""
with recursive {_EDGES},
reach as (select hierarchy, child as a, parent as b from edges
  union select r.hierarchy, r.a, e.parent from reach r join edges e on e.hierarchy = r.hierarchy and e.child = r.b),
cyc as (select x.hierarchy, min(least(x.a, x.b)) as cycle_id, x.a as node_id
  from reach x join reach y on y.hierarchy = x.hierarchy and y.a = x.b and y.b = x.a group by x.hierarchy, x.a)
"""
_BELOW = """
below(hierarchy, node_id, ancestor_id, distance) using key (hierarchy, node_id, ancestor_id) as (
  select hierarchy, child, parent, 1 from edges where child <> parent
  union
  select b.hierarchy, b.node_id, e.parent, b.distance + 1 from below b join edges e on e.hierarchy = b.hierarchy and e.child = b.ancestor_id
  where e.parent <> b.node_id and not exists (select 1 from recurring.below k where k.hierarchy = b.hierarchy and k.node_id = b.node_id and k.ancestor_id = e.parent))
"""
_FOREST = (
    _CYCLES
    + f""",
{_BELOW},
reps as (select hierarchy, child as node_id from edges union select hierarchy, parent from edges),
nodes as (select r.hierarchy, r.node_id, coalesce(c.cycle_id, r.node_id) as rep, c.cycle_id is not null as in_cycle
  from reps r left join cyc c on c.hierarchy = r.hierarchy and c.node_id = r.node_id),
up as (select e.hierarchy, a.rep as node_id, min(b.rep) as parent from edges e
  join nodes a on a.hierarchy = e.hierarchy and a.node_id = e.child join nodes b on b.hierarchy = e.hierarchy and b.node_id = e.parent
  where a.rep <> b.rep group by all),
walk as (select hierarchy, node_id, in_cycle, rep as at, 0 as depth, node_id::varchar as path from nodes
  union all select w.hierarchy, w.node_id, w.in_cycle, u.parent, w.depth + 1, u.parent::varchar || '/' || w.path
  from walk w join up u on u.hierarchy = w.hierarchy and u.node_id = w.at),
counts as (select hierarchy, ancestor_id, count(*) as n from below group by all)
"""
)
_ORPHANS = """
refs as (
  select rel_id, 'from' as endpoint, from_id as k, type, seen_at from graph_relationship where from_id is not null
  union all select rel_id, 'to', to_id, type, seen_at from graph_relationship where to_id is not null),
recs as (select node_id as id, created_at, deleted_at from graph_node where node_id is not null
  union all select node_id, created_at, deleted_at from shared_node where node_id is not null),
firsts as (select id, case when bool_or(created_at is null) then null else min(created_at) end as first from recs group by id),
orphan as (
  select r.rel_id, r.endpoint, r.k, r.type, r.seen_at,
    case when f.id is null then 'missing' when f.first > r.seen_at then 'late' else 'deleted' end as reason
  from refs r left join firsts f on f.id = r.k
  where not exists (select 1 from recs n where n.id = r.k and n.created_at <= r.seen_at and (n.deleted_at is null or r.seen_at < n.deleted_at)))
"""
_T = "upper(trim(type, ' ' || chr(9) || chr(10) || chr(13)))"

SQL = {
    "p1_found": _CYCLES + "select hierarchy, cycle_id, node_id from cyc",
    "p1_paths": _FOREST
    + """select w.hierarchy, w.node_id, w.at as root_id, w.depth, w.path, coalesce(n, 0) as n_descendants, w.in_cycle
from walk w left join counts c on c.hierarchy = w.hierarchy and c.ancestor_id = w.node_id
where not exists (select 1 from up u where u.hierarchy = w.hierarchy and u.node_id = w.at)""",
    "p1_descendants": f"with recursive {_EDGES}, {_BELOW} select hierarchy, ancestor_id, node_id, distance from below",
    "p1_roots": _CYCLES
    + """, nodes as (select hierarchy, child as node_id from edges union select hierarchy, parent from edges),
above as (select hierarchy, a as node_id, b as root_id from reach union select hierarchy, node_id, node_id from nodes),
roots as (select hierarchy, node_id as root_id from nodes n where not exists (
  select 1 from reach r where r.hierarchy = n.hierarchy and r.a = n.node_id and r.b <> n.node_id
  and (r.b < n.node_id or not exists (select 1 from reach q where q.hierarchy = r.hierarchy and q.a = r.b and q.b = r.a))))
select a.hierarchy, a.node_id, a.root_id from above a join roots r on r.hierarchy = a.hierarchy and r.root_id = a.root_id""",
    "p4_found": f"with {_ORPHANS} select distinct rel_id, endpoint, reason from orphan",
    "p4_report": f"""with {_ORPHANS} select 'graph_relationship' as origin, {_T} as type, endpoint, strftime(seen_at, '%Y-%m') as month, reason,
  count(*) as n_references, count(distinct rel_id) as n_edges from orphan group by all""",
    "p4_cascade": f"""with recursive {_EDGES}, {_ORPHANS},
start as (select distinct case when {_T} in ('INHERITS','IMPLEMENTS') then 'inheritance' else 'containment' end as hierarchy,
    case when {_T} in ('INHERITS','IMPLEMENTS') then g.from_id else g.to_id end as node_id
  from graph_relationship g where g.from_id is not null and g.to_id is not null
  and {_T} in ('INHERITS','IMPLEMENTS','CONTAINS_PACKAGE','CONTAINS_FOLDER','CONTAINS_FILE','CONTAINS_MODULE','DEFINES','DEFINES_METHOD')
  and not exists (select 1 from recs n where n.id = (case when {_T} in ('INHERITS','IMPLEMENTS') then g.to_id else g.from_id end)
    and n.created_at <= g.seen_at and (n.deleted_at is null or g.seen_at < n.deleted_at))),
down as (select hierarchy, node_id, 0 as level from start
  union select d.hierarchy, e.child, d.level + 1 from down d join edges e on e.hierarchy = d.hierarchy and e.parent = d.node_id where d.level < 200)
select hierarchy, node_id, min(level) as level, case when min(level) = 0 then 'direct' else 'inherited' end as kind from down group by hierarchy, node_id""",
}
