"""Queries on the property graph and its operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions import modules, names, paths, text, vector
from canopy.graph import Graph
from canopy.operators import incremental, mutate, resolve, traverse, vectors
from canopy.session import cut, table
from canopy.sources import extract, repository
from canopy.sources.languages import PACKAGE_FILES
from canopy.streaming import debounce

QUERIES: dict = {}
SQL: dict[str, str] = {}

_ALIVE = """alive as (select * from (select node_id, labels, properties, project, created_at, deleted_at from graph_node
  union all select node_id, labels, properties, project, created_at, deleted_at from shared_node) where node_id is not null and deleted_at is null)"""
_GRAPH = f"""{_ALIVE},
kv as (select node_id, created_at, unnest(map_entries(properties)) as e from alive where properties is not null),
props as (select node_id, e.key as k, max({{'c': created_at, 'v': e.value}}).v as v from kv where e.value is not null group by node_id, e.key),
heads as (select node_id, max({{'c': created_at, 'v': labels[1]}}).v as label, max(case when project is not null then {{'c': created_at, 'v': project}} end).v as project from alive group by node_id),
pv as (select node_id, max(case when k = 'name' then v end) as name, max(case when k = 'qualified_name' then v end) as qualified_name, max(case when k = 'path' then v end) as path,
  max(case when k = 'extension' then v end) as extension, max(case when k = 'start_line' then v end) as start_line, max(case when k = 'is_exported' then v end) as is_exported from props group by node_id),
nodes as (select h.node_id, h.label, h.project, p.name, p.qualified_name, p.path, p.extension, p.start_line, p.is_exported from heads h left join pv p on p.node_id = h.node_id),
edges as (select rel_id, min(from_id) as from_id, min(to_id) as to_id, min(upper(trim(type, ' ' || chr(9) || chr(10) || chr(13)))) as type, max(properties['line']) as line, max(properties['version_spec']) as version_spec
  from graph_relationship where rel_id is not null and from_id is not null and to_id is not null group by rel_id)"""


def add(sql: str | None = None, graph: bool = True):  # noqa: ANN201
    """Registers a query with its SQL, which sees `nodes` and `edges` if `graph`."""

    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            if graph:
                body = f"with recursive {_GRAPH}, {body[5:].lstrip()}" if body.startswith("with ") else f"with recursive {_GRAPH} {body}"
            elif body.startswith("with "):
                body = f"with recursive {body[5:]}"
            SQL[f.__name__] = body
        return f

    return keep


def cypher(name: str, statement: str, sql: str, **params: object) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Graph.from_tables(spark, d).cypher(statement, **params)

    run.__name__ = name
    add(sql)(run)


# Scans, predicates and projections.
cypher("match_all_nodes", "MATCH (n) RETURN id(n) AS node_id, labels(n)[0] AS label", "select node_id, label from nodes")
cypher("match_label_scan", "MATCH (f:File) RETURN f.path AS path, f.name AS name, f.extension AS extension", "select path, name, extension from nodes where label = 'File'")
cypher("match_label_disjunction", "MATCH (n:Function|Method) RETURN n.qualified_name AS qualified_name, labels(n)[0] AS type", "select qualified_name, label as type from nodes where label in ('Function','Method')")
cypher("match_label_predicate", "MATCH (n) WHERE (n:Class OR n:Interface) RETURN id(n) AS node_id, n.name AS name", "select node_id, name from nodes where label in ('Class','Interface')")
cypher("inline_property_map", "MATCH (f:File {extension: $ext}) RETURN f.path AS path", "select path from nodes where label = 'File' and extension = '.py'", ext=".py")
cypher("prop_eq", "MATCH (f:File) WHERE f.extension = '.java' RETURN f.path AS path, f.name AS name", "select path, name from nodes where label = 'File' and extension = '.java'")
cypher("starts_with", "MATCH (n) WHERE n.path IS NOT NULL AND n.path STARTS WITH 's' RETURN n.name AS name, n.path AS path, labels(n) AS type", "select name, path, [label] as type from nodes where path is not null and starts_with(path, 's')")
cypher("contains_lower", "MATCH (n) WHERE toLower(n.name) CONTAINS 'trie' OR (n.qualified_name IS NOT NULL AND toLower(n.qualified_name) CONTAINS 'cache') RETURN id(n) AS node_id, n.name AS name", "select node_id, name from nodes where contains(lower(name), 'trie') or (qualified_name is not null and contains(lower(qualified_name), 'cache'))")
cypher("ends_with", "MATCH (n:Method) WHERE n.qualified_name ENDS WITH 'queue' RETURN n.qualified_name AS qualified_name", "select qualified_name from nodes where label = 'Method' and ends_with(qualified_name, 'queue')")
cypher("is_null", "MATCH (m:Module) WHERE m.is_exported IS NULL OR m.is_exported = 'false' RETURN m.path AS path", "select path from nodes where label = 'Module' and (is_exported is null or is_exported = 'false')")
cypher("in_list", "MATCH (f:File) WHERE f.extension IN ['.py', '.ts', '.go'] RETURN f.path AS path, f.extension AS extension", "select path, extension from nodes where label = 'File' and extension in ('.py','.ts','.go')")
cypher("in_parameter", "MATCH (f:File) WHERE f.extension IN $exts AND NOT f.name STARTS WITH 'a' RETURN f.path AS path", "select path from nodes where label = 'File' and extension in ('.js','.lua') and not starts_with(name, 'a')", exts=[".js", ".lua"])
cypher("any_predicate", "MATCH (n) WHERE ANY(l IN labels(n) WHERE toLower(l) IN ['function', 'class']) RETURN id(n) AS node_id", "select node_id from nodes where len(list_filter([label], lambda l: lower(l) in ('function','class'))) > 0")
cypher("array_membership", "MATCH (n) WHERE 'Package' IN labels(n) RETURN n.qualified_name AS qualified_name", "select qualified_name from nodes where list_contains([label], 'Package')")
cypher("distinct_labels", "MATCH (n) RETURN DISTINCT labels(n)[0] AS label", "select distinct label from nodes")
cypher("distinct_types", "MATCH ()-[r]->() RETURN DISTINCT type(r) AS type", "select distinct type from edges e where exists (select 1 from nodes n where n.node_id = e.from_id) and exists (select 1 from nodes n where n.node_id = e.to_id)")
cypher("nodes_by_ids_ordered", "MATCH (n) WHERE id(n) IN $ids RETURN id(n) AS node_id, n.qualified_name AS qualified_name ORDER BY n.qualified_name", "select node_id, qualified_name from nodes where node_id in (1001,1002,1003,1500,2000,2500,3000,3500)", ids=[1001, 1002, 1003, 1500, 2000, 2500, 3000, 3500])
cypher("list_projects", "MATCH (p:Project) RETURN p.name AS name ORDER BY p.name", "select name from nodes where label = 'Project'")

# Expansion.
cypher("expand_typed", "MATCH (m:Module)-[:DEFINES]->(n) WHERE (n:Function OR n:Method) RETURN id(n) AS node_id, n.qualified_name AS qualified_name, m.path AS path", "select n.node_id, n.qualified_name, m.path from edges e join nodes m on m.node_id = e.from_id join nodes n on n.node_id = e.to_id where e.type = 'DEFINES' and m.label = 'Module' and n.label in ('Function','Method')")
cypher("class_methods", "MATCH (c:Class)-[:DEFINES_METHOD]->(m:Method) WHERE c.name CONTAINS 'Session' OR c.name STARTS WITH 'A' RETURN c.name AS class, m.name AS method", "select c.name as class, m.name as method from edges e join nodes c on c.node_id = e.from_id join nodes m on m.node_id = e.to_id where e.type = 'DEFINES_METHOD' and c.label = 'Class' and m.label = 'Method' and (contains(c.name, 'Session') or starts_with(c.name, 'A'))")
cypher("expand_any", "MATCH (a)-[r]->(b) RETURN id(a) AS from_id, id(b) AS to_id, type(r) AS type, r.line AS line", "select a.node_id as from_id, b.node_id as to_id, e.type, e.line from edges e join nodes a on a.node_id = e.from_id join nodes b on b.node_id = e.to_id")
cypher("expand_incoming", "MATCH (f:Function)<-[:CALLS]-(c:Method) RETURN id(f) AS callee, id(c) AS caller", "select f.node_id as callee, c.node_id as caller from edges e join nodes f on f.node_id = e.to_id join nodes c on c.node_id = e.from_id where e.type = 'CALLS' and f.label = 'Function' and c.label = 'Method'")
cypher("expand_undirected", "MATCH (c:Class)-[r:INHERITS]-(o:Class) RETURN id(c) AS a, id(o) AS b, id(r) AS rel_id", "with u as (select rel_id, from_id as s, to_id as t from edges where type = 'INHERITS' union all select rel_id, to_id, from_id from edges where type = 'INHERITS' and from_id <> to_id) select c.node_id as a, o.node_id as b, u.rel_id from u join nodes c on c.node_id = u.s join nodes o on o.node_id = u.t where c.label = 'Class' and o.label = 'Class'")
cypher("expand_two_hop", "MATCH (m:Module)-[:DEFINES]->(c:Class)-[:DEFINES_METHOD]->(f:Method) RETURN m.qualified_name AS module, c.name AS class, f.name AS method", "select m.qualified_name as module, c.name as class, f.name as method from edges a join edges b on b.from_id = a.to_id and b.rel_id <> a.rel_id join nodes m on m.node_id = a.from_id join nodes c on c.node_id = a.to_id join nodes f on f.node_id = b.to_id where a.type = 'DEFINES' and b.type = 'DEFINES_METHOD' and m.label = 'Module' and c.label = 'Class' and f.label = 'Method'")
cypher("optional_match", "MATCH (c:Class) OPTIONAL MATCH (c)-[:DEFINES_METHOD]->(m:Method) RETURN id(c) AS class_id, m.name AS method", "with x as (select e.from_id, m.name from edges e join nodes m on m.node_id = e.to_id where e.type = 'DEFINES_METHOD' and m.label = 'Method') select c.node_id as class_id, x.name as method from nodes c left join x on x.from_id = c.node_id where c.label = 'Class'")
cypher("chained_match", "MATCH (a:Function)-[:CALLS]->(b:Function) OPTIONAL MATCH (b)-[:DEFINES]->(c) RETURN id(a) AS a, id(b) AS b, c.name AS inner", "with x as (select e.from_id, c.name from edges e join nodes c on c.node_id = e.to_id where e.type = 'DEFINES') select a.node_id as a, b.node_id as b, x.name as inner from edges e join nodes a on a.node_id = e.from_id join nodes b on b.node_id = e.to_id left join x on x.from_id = b.node_id where e.type = 'CALLS' and a.label = 'Function' and b.label = 'Function'")
cypher("type_alternation", "MATCH (p)-[r:CONTAINS_FILE|CONTAINS_FOLDER]->(c) RETURN id(p) AS parent, id(c) AS child, type(r) AS type", "select a.node_id as parent, b.node_id as child, e.type from edges e join nodes a on a.node_id = e.from_id join nodes b on b.node_id = e.to_id where e.type in ('CONTAINS_FILE','CONTAINS_FOLDER')")

# Aggregation, order and limits.
cypher("count_all", "MATCH (c:Class) RETURN count(c) AS total", "select count(*) as total from nodes where label = 'Class'")
cypher("stats_node_counts", "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS count ORDER BY count DESC", "select label, count(*) as count from nodes group by label")
cypher("stats_rel_counts", "MATCH ()-[r]->() RETURN type(r) AS type, count(*) AS count ORDER BY count DESC", "select type, count(*) as count from edges e join nodes a on a.node_id = e.from_id join nodes b on b.node_id = e.to_id group by type")
cypher("count_distinct_callees", "MATCH (a)-[:CALLS]->(b) RETURN labels(a)[0] AS caller, count(DISTINCT b) AS callees, count(*) AS calls", "select a.label as caller, count(distinct b.node_id) as callees, count(*) as calls from edges e join nodes a on a.node_id = e.from_id join nodes b on b.node_id = e.to_id where e.type = 'CALLS' group by a.label")
cypher("with_having", "MATCH (c:Class)-[:DEFINES_METHOD]->(m) WITH c, count(m) AS n WHERE n >= 3 RETURN c.qualified_name AS qualified_name, n ORDER BY n DESC", "select c.qualified_name, count(*) as n from edges e join nodes c on c.node_id = e.from_id join nodes m on m.node_id = e.to_id where e.type = 'DEFINES_METHOD' and c.label = 'Class' group by c.node_id, c.qualified_name having count(*) >= 3")
cypher("collect_methods", "MATCH (c:Class)-[:DEFINES_METHOD]->(m:Method) RETURN id(c) AS class_id, collect(DISTINCT m.name) AS methods", "select c.node_id as class_id, list_sort(list(distinct m.name)) as methods from edges e join nodes c on c.node_id = e.from_id join nodes m on m.node_id = e.to_id where e.type = 'DEFINES_METHOD' and c.label = 'Class' and m.label = 'Method' group by c.node_id")
cypher("line_statistics", "MATCH ()-[r:CALLS]->() RETURN min(toInteger(r.line)) AS least, max(toInteger(r.line)) AS most, sum(toInteger(r.line)) AS total", "select min(line::bigint) as least, max(line::bigint) as most, sum(line::bigint)::bigint as total from edges e join nodes a on a.node_id = e.from_id join nodes b on b.node_id = e.to_id where e.type = 'CALLS'")
cypher("topk_order_limit", "MATCH (m:Method) RETURN id(m) AS node_id, m.qualified_name AS qualified_name ORDER BY m.qualified_name, id(m) LIMIT 50", "select node_id, qualified_name from nodes where label = 'Method' order by qualified_name nulls last, node_id limit 50")
cypher("skip_limit", "MATCH (f:Function) RETURN id(f) AS node_id ORDER BY id(f) DESC SKIP 10 LIMIT 20", "select node_id from nodes where label = 'Function' order by node_id desc limit 20 offset 10")
cypher("order_nulls_last", "MATCH (n) RETURN id(n) AS node_id, n.path AS path ORDER BY n.path, id(n) LIMIT 500", "select node_id, path from nodes order by path nulls last, node_id limit 500")
cypher("order_desc_nulls_first", "MATCH (n) RETURN id(n) AS node_id, n.path AS path ORDER BY n.path DESC, id(n) LIMIT 100", "select node_id, path from nodes order by path desc nulls first, node_id limit 100")


@add("select label, count(*) as n from nodes group by rollup(label)")
def stats_with_total(spark: SparkSession, d: str) -> DataFrame:
    nodes = Graph.from_tables(spark, d).nodes.select(F.try_element_at("labels", F.lit(1)).alias("label"))
    return nodes.rollup("label").agg(F.count("*").alias("n"))


@add("select 'label' as kind, label as name, count(*) as n from nodes where label is not null group by label union all select 'type', type, count(*) from edges group by type")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return Graph.from_tables(spark, d).summary()


@add("select node_id, label, project, name, qualified_name, path from nodes")
def export_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = Graph.from_tables(spark, d).nodes
    return nodes.select("node_id", F.try_element_at("labels", F.lit(1)).alias("label"), "project", *(F.try_element_at("properties", F.lit(p)).alias(p) for p in ("name", "qualified_name", "path")))


@add("select from_id, to_id, type, line, version_spec from edges")
def export_relationships(spark: SparkSession, d: str) -> DataFrame:
    edges = Graph.from_tables(spark, d).edges
    return edges.select("from_id", "to_id", "type", *(F.try_element_at("properties", F.lit(p)).alias(p) for p in ("line", "version_spec")))


@add("select e.rel_id, 'outgoing' as direction from edges e join nodes n on n.node_id = e.from_id where n.label = 'Interface' union all select e.rel_id, 'incoming' from edges e join nodes n on n.node_id = e.to_id where n.label = 'Interface'")
def loader_relationships(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    return g.relationships(g.labelled("Interface").select(F.col("node_id").alias("id"))).select("rel_id", "direction")


@add("select type, count(*) as attempted, count(a.node_id + b.node_id) as matched, count(*) - count(a.node_id + b.node_id) as failed from edges e left join nodes a on a.node_id = e.from_id left join nodes b on b.node_id = e.to_id group by type")
def merge_match_count(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    ids = lambda c: g.nodes.select(F.col("node_id").alias(c))
    joined = g.edges.join(ids("a"), F.col("from_id") == F.col("a"), "left").join(ids("b"), F.col("to_id") == F.col("b"), "left")
    return joined.groupBy("type").agg(F.count("*").alias("attempted"), F.count(F.col("a") + F.col("b")).alias("matched"), (F.count("*") - F.count(F.col("a") + F.col("b"))).alias("failed"))


@add("with ranked as (select node_id, qualified_name, (length(qualified_name) + 3) // 4 as cost, row_number() over (order by qualified_name, node_id) as place from nodes where label = 'Method' and qualified_name is not null), capped as (select *, sum(cost) over (order by qualified_name, node_id) as spent from ranked where place <= 500) select node_id, cost::bigint as cost, spent::bigint as spent from capped where spent <= 4000 or place = 1")
def token_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    rows = g.cypher("MATCH (m:Method) WHERE m.qualified_name IS NOT NULL RETURN id(m) AS node_id, m.qualified_name AS qualified_name ORDER BY m.qualified_name, id(m) LIMIT 500")
    kept = text.within_budget(rows.withColumn("cost", text.tokens(F.col("qualified_name"))), ["qualified_name", "node_id"], "cost", 4000)
    return kept.select("node_id", "cost", "spent")


# Traversal.
@add("with steps as (select distinct from_id, to_id from edges where type = 'INHERITS'), reach as (select from_id as start, to_id as id from steps union select r.start, e.to_id from reach r join steps e on e.from_id = r.id) select start, id from reach")
def reachable_directed(spark: SparkSession, d: str) -> DataFrame:
    steps = Graph.from_tables(spark, d).steps("INHERITS")
    return traverse.reachable(steps.select(F.col("src").alias("start")), steps).select("start", "id")


@add("with steps as (select distinct from_id, to_id from edges where type in ('CONTAINS_PACKAGE','CONTAINS_FOLDER','CONTAINS_FILE','CONTAINS_MODULE','DEFINES','DEFINES_METHOD')), reach as (select node_id as id from nodes where label = 'Project' union select e.to_id from reach r join steps e on e.from_id = r.id) select id from reach")
def reachable_zero_hop(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    steps = g.steps("CONTAINS_PACKAGE", "CONTAINS_FOLDER", "CONTAINS_FILE", "CONTAINS_MODULE", "DEFINES", "DEFINES_METHOD")
    return traverse.reach_set(g.labelled("Project").select(F.col("node_id").alias("id")), steps)


@add("with steps as (select distinct from_id, to_id from edges where type = 'OVERRIDES' union select to_id, from_id from edges where type = 'OVERRIDES'), reach as (select from_id as start, to_id as id from steps union select r.start, e.to_id from reach r join steps e on e.from_id = r.id) select start, id from reach")
def reachable_undirected(spark: SparkSession, d: str) -> DataFrame:
    steps = traverse.both_ways(Graph.from_tables(spark, d).steps("OVERRIDES"))
    return traverse.reachable(steps.select(F.col("src").alias("start")), steps).select("start", "id")


@add("with hops as (select from_id as start, to_id as id, 1 as n from (select distinct from_id, to_id from edges where type = 'CALLS') s union select h.start, e.to_id, h.n + 1 from hops h join (select distinct from_id, to_id from edges where type = 'CALLS') e on e.from_id = h.id where h.n < 2) select start, id, min(n) as hops from hops group by start, id")
def reachable_bounded(spark: SparkSession, d: str) -> DataFrame:
    steps = Graph.from_tables(spark, d).steps("CALLS")
    return traverse.reachable(steps.select(F.col("src").alias("start")), steps, 1, 2)


_METHODS = """own as (select distinct c.node_id as class_id, regexp_extract(m.name, '^[a-z]+') as name from edges e join nodes c on c.node_id = e.from_id join nodes m on m.node_id = e.to_id where e.type = 'DEFINES_METHOD' and m.name is not null),
parents as (select from_id as src, to_id as dst, row_number() over (partition by from_id order by rel_id) as ord from (select from_id, to_id, min(rel_id) as rel_id from edges where type = 'INHERITS' group by from_id, to_id) i),
up as (select distinct class_id as start, class_id as id, []::int[] as route from own
  union all select u.start, p.dst, list_append(u.route, p.ord::int) from up u join parents p on p.src = u.id where len(u.route) < 12),
firsts as (select start, id, min({'n': len(route), 'r': route}) as m from up group by start, id)"""


def _methods(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Classes with the verbs of their methods (hardly any two related classes of these tables share a whole name), and parents."""
    own = g.cypher("MATCH (c)-[:DEFINES_METHOD]->(m) WHERE m.name IS NOT NULL RETURN id(c) AS start, m.name AS name")
    own = own.select("start", F.regexp_extract("name", "^[a-z]+", 0).alias("name")).distinct()
    inherits = g.edges.where("type = 'INHERITS'").groupBy("from_id", "to_id").agg(F.min("rel_id").alias("rel_id"))
    order = F.row_number().over(Window.partitionBy("from_id").orderBy("rel_id"))
    return cut(own), cut(inherits.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), order.alias("ord")))


@add(f"with {_METHODS}, hits as (select distinct w.class_id as start, w.name, o.class_id as id, f.m from own w join firsts f on f.start = w.class_id join own o on o.class_id = f.id and o.name = w.name where f.id <> w.class_id) select start, name, arg_min(id, m) as ancestor, min(m).n::int as hops from hits group by start, name")
def override_detection(spark: SparkSession, d: str) -> DataFrame:
    own, parents = _methods(Graph.from_tables(spark, d))
    hits = own.select(F.col("start").alias("id"), "name")
    return traverse.nearest_hits(own, parents, hits).where("start <> id").select("start", "name", F.col("id").alias("ancestor"), F.col("hops").cast("int").alias("hops"))


@add(f"with {_METHODS}, up2 as (select distinct src as start, src as id, []::int[] as route from parents union all select u.start, p.dst, list_append(u.route, p.ord::int) from up2 u join parents p on p.src = u.id where len(u.route) < 12), f2 as (select start, id, min({{'n': len(route), 'r': route}}) as m from up2 group by start, id), hits as (select distinct f.start, o.name, o.class_id as id, f.m from f2 f join own o on o.class_id = f.id) select start, name, arg_min(id, m) as owner, min(m).n::int as hops from hits group by start, name")
def inherited_method(spark: SparkSession, d: str) -> DataFrame:
    """Who answers each method that a class with parents has or inherits."""
    own, parents = _methods(Graph.from_tables(spark, d))
    below = traverse.reachable(parents.select(F.col("src").alias("start")), parents, min_hops=0)
    starts = below.join(own.withColumnRenamed("start", "id"), "id").select("start", "name").distinct()
    found = traverse.nearest_hits(starts, parents, own.select(F.col("start").alias("id"), "name"), own=True)
    return found.select("start", "name", F.col("id").alias("owner"), F.col("hops").cast("int").alias("hops"))


# Writes.
_STAGE = """stage as (select labels[1] as label, properties['qualified_name'] as key, e.key as property, case when deleted_at is null then e.value end as value, epoch_us(coalesce(deleted_at, created_at)) as seq
  from (select labels, properties, created_at, deleted_at, unnest(map_entries(properties)) as e from graph_node where properties is not null) g where properties['qualified_name'] is not null)"""


def _staging(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the node table as an upsert of its properties; a deleted row sets them to null."""
    rows = table(spark, d, "graph_node").where("properties is not null")
    rows = rows.select(F.try_element_at("labels", F.lit(1)).alias("label"), F.try_element_at("properties", F.lit("qualified_name")).alias("key"), F.col("deleted_at").isNotNull().alias("gone"), F.unix_micros(F.coalesce("deleted_at", "created_at")).alias("seq"), F.explode("properties").alias("property", "value"))
    return rows.where("key is not null").select("label", "key", "property", F.when(~F.col("gone"), F.col("value")).alias("value"), "seq")


@add(f"with {_STAGE}, last as (select label, key, property, max({{'s': seq, 'n': value is not null, 'v': value}}) as m from stage group by label, key, property) select label, key, property, m.v as value from last where m.v is not null", graph=False)
def merge_nodes_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return mutate.merge_properties(_staging(spark, d))


@add(f"with {_STAGE}, last as (select label, key, property, max({{'s': seq, 'n': value is not null, 'v': value}}) as m from stage group by label, key, property) select label, count(*) as removed from last where m.v is null group by label", graph=False)
def merge_nodes_null_removes(spark: SparkSession, d: str) -> DataFrame:
    stage = _staging(spark, d)
    every = stage.select("label", "key", "property").distinct()
    gone = every.join(mutate.merge_properties(stage), ["label", "key", "property"], "left_anti")
    return gone.groupBy("label").agg(F.count("*").alias("removed"))


def _staged_edges(g: Graph) -> DataFrame:
    """The edges as staging by label and key, as an extraction would write them."""
    keyed = g.nodes.select("node_id", F.try_element_at("labels", F.lit(1)).alias("label"), mutate.key_column().alias("key"))
    end = lambda e: keyed.select(F.col("node_id").alias(f"{e}_id"), F.col("label").alias(f"{e}_label"), F.col("key").alias(f"{e}_key"))
    rows = g.edges.join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")
    return rows.select("from_label", "from_key", "type", "to_label", "to_key", "properties", F.col("rel_id").alias("seq"))


_KEYED = """keyed as (select node_id, label, case when label in ('Project','ExternalPackage') then name when label in ('Folder','File') then path else qualified_name end as key from nodes),
stage as (select a.label as from_label, a.key as from_key, e.type, b.label as to_label, b.key as to_key, e.line, e.rel_id from edges e left join keyed a on a.node_id = e.from_id left join keyed b on b.node_id = e.to_id),
ends as (select s.*, a.node_id as from_id, b.node_id as to_id from stage s join keyed a on a.label = s.from_label and a.key = s.from_key join keyed b on b.label = s.to_label and b.key = s.to_key)"""


@add(f"with {_KEYED} select from_id, to_id, type, arg_max(line, rel_id) filter (line is not null) as line from ends group by from_id, to_id, type")
def merge_edges_requires_endpoints(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    stage = cut(_staged_edges(g))
    merged = mutate.merge_edges(Graph(g.nodes, g.edges.limit(0)), stage)
    return merged.edges.select("from_id", "to_id", "type", F.try_element_at("properties", F.lit("line")).alias("line"))


@add(f"with {_KEYED} select type, count(*) as n from ends group by type")
def create_edges_dup(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    made = mutate.create_edges(Graph(g.nodes, g.edges.limit(0)), cut(_staged_edges(g)))
    return made.edges.groupBy("type").agg(F.count("*").alias("n"))


@add("select e.rel_id, e.type from edges e where not exists (select 1 from nodes n where n.node_id = e.from_id) or not exists (select 1 from nodes n where n.node_id = e.to_id)")
def unmatched_edges(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    return g.edges.join(g.with_endpoints().edges.select("rel_id"), "rel_id", "left_anti").select("rel_id", "type")


@add("with keyed as (select labels[1] as label, case when labels[1] in ('Project','ExternalPackage') then properties['name'] when labels[1] in ('File','Folder') then properties['path'] else properties['qualified_name'] end as key from graph_node where properties is not null and labels is not null) select label, key, count(*) as n from keyed where key is not null group by label, key having count(*) > 1", graph=False)
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    """Keys that several rows of the raw node table have, that is before rows are merged."""
    return mutate.violations(table(spark, d, "graph_node").where("properties is not null and labels is not null"))


@add("with r as (select node_id, labels[1] as label, created_at, properties['name'] as name from graph_node where node_id is not null) select node_id, min({'c': created_at, 'l': label, 'n': coalesce(name, '')}).l as label, min({'c': created_at, 'l': label, 'n': coalesce(name, '')}).n as name from r group by node_id", graph=False)
def protobuf_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_node").where("node_id is not null").select("node_id", "created_at", F.try_element_at("labels", F.lit(1)).alias("label"), F.coalesce(F.try_element_at("properties", F.lit("name")), F.lit("")).alias("name"))
    return mutate.first_wins(rows, ["node_id"], "created_at").select("node_id", "label", "name")


@add("select from_id, to_id, type, count(*) as n from edges group by from_id, to_id, type")
def edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return Graph.from_tables(spark, d).edges.groupBy("from_id", "to_id", "type").agg(F.count("*").alias("n"))


_FIRST_PROJECT = "(select min(name) from nodes where label = 'Project')"


def _project(g: Graph) -> str:
    return g.labelled("Project").agg(F.min(F.try_element_at("properties", F.lit("name")))).first()[0] or ""


@add(f"with h as (select node_id as id from nodes where label = 'Project' and name = {_FIRST_PROJECT} union select e.to_id from h join edges e on e.from_id = h.id and e.type in ('CONTAINS_PACKAGE','CONTAINS_FOLDER','CONTAINS_FILE','CONTAINS_MODULE')), g as (select id from h union select e.to_id from g join edges e on e.from_id = g.id and e.type in ('DEFINES','DEFINES_METHOD')) select n.node_id from nodes n where n.node_id not in (select id from g)")
def delete_project(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    return mutate.delete_project(g, _project(g)).nodes.select("node_id")


_FIRST_MODULE = "(select min(path) from nodes where label = 'Module')"


@add(f"with g as (select node_id as id from nodes where label = 'Module' and path = {_FIRST_MODULE} union select e.to_id from g join edges e on e.from_id = g.id) select e.rel_id from edges e where e.from_id not in (select id from g) and e.to_id not in (select id from g)")
def delete_closure(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    path = g.labelled("Module").agg(F.min(F.try_element_at("properties", F.lit("path")))).first()[0]
    return mutate.delete_module(g, path).edges.select("rel_id")


@add("select type, count(*) as n from edges where type is null or type <> 'CALLS' group by type")
def delete_by_type(spark: SparkSession, d: str) -> DataFrame:
    return mutate.delete_edges(Graph.from_tables(spark, d), "CALLS").edges.groupBy("type").agg(F.count("*").alias("n"))


@add("with p as (select min(path) as path from nodes where label = 'File'), x as (select node_id from nodes n, p where n.label = 'File' and n.path = p.path) select rel_id from edges where from_id not in (select node_id from x) and to_id not in (select node_id from x)")
def delete_file(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    path = g.labelled("File").agg(F.min(F.try_element_at("properties", F.lit("path")))).first()[0]
    return mutate.delete_path(g, "File", path).edges.select("rel_id")


@add("select n.node_id, n.label, n.path from nodes n where n.label in ('File','Folder','Module') and n.path is not null and not exists (select 1 from code_snippet s where s.project = n.project and s.file_path = n.path)")
def prune_orphans(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "code_snippet").select("project", F.col("file_path").alias("path"))
    gone = mutate.orphans(Graph.from_tables(spark, d).nodes, listing)
    return gone.select("node_id", F.try_element_at("labels", F.lit(1)).alias("label"), "path")


# Names and paths.
_PARTS = ", ".join(f"'{p}'" for p in paths.IGNORED_PARTS)
_SUFFIXES = ", ".join(f"'{p}'" for p in paths.IGNORED_SUFFIXES)


@add(
    f"""select distinct file_path as path, case when regexp_extract(split_part(file_path, '/', -1), '^.+(\\.[^.]+)$', 1) in ({_SUFFIXES}) then true
  when list_has_any(string_split(file_path, '/')[:-2], ['external', 'deps']) or file_path = 'external' or starts_with(file_path, 'external/') or file_path = 'deps' or starts_with(file_path, 'deps/') then true
  when file_path = 'dist/registry' or starts_with(file_path, 'dist/registry/') then false
  else list_has_any(string_split(file_path, '/')[:-2], [{_PARTS}]) end as skipped from code_snippet where file_path is not null""",
    graph=False,
)
def skip_path(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_snippet").where("file_path is not null").select(F.col("file_path").alias("path")).distinct()
    return rows.select("path", paths.should_skip(F.col("path"), True, ["external", "deps"], ["dist/registry"]).alias("skipped"))


@add("select distinct file_path as path, case when contains(file_path, '/') then regexp_replace(file_path, '/[^/]*$', '') else '.' end as parent, split_part(file_path, '/', -1) as name, regexp_extract(split_part(file_path, '/', -1), '^.+(\\.[^.]+)$', 1) as suffix from code_snippet where file_path is not null", graph=False)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    rows = table(spark, d, "code_snippet").where("file_path is not null").select(F.col("file_path").alias("path")).distinct()
    return rows.select("path", paths.parent(p).alias("parent"), paths.name(p).alias("name"), paths.suffix(p).alias("suffix"))


@add("select distinct project, path, project || '.' || replace(regexp_replace(regexp_replace(path, '/(__init__\\.py|mod\\.rs)$', ''), '\\.[^./]+$', ''), '/', '.') as module from nodes where label = 'Module' and path is not null and project is not null")
def module_names(spark: SparkSession, d: str) -> DataFrame:
    rows = Graph.from_tables(spark, d).cypher("MATCH (m:Module) WHERE m.path IS NOT NULL RETURN m.project AS project, m.path AS path").where("project is not null").distinct()
    return rows.select("project", "path", paths.module_name(F.col("project"), F.col("path")).alias("module"))


_DEFS = "defs as (select node_id, qualified_name, name from nodes where label in ('Function','Method','Class') and qualified_name is not null)"


def _defs(g: Graph) -> DataFrame:
    return g.cypher("MATCH (n:Function|Method|Class) WHERE n.qualified_name IS NOT NULL RETURN id(n) AS node_id, n.qualified_name AS qualified_name, n.name AS name")


@add(f"with {_DEFS}, w as (select distinct split_part(qualified_name, '.', -1) as suffix from defs union select distinct array_to_string(string_split(qualified_name, '.')[-2:], '.') from defs), named as (select w.suffix, d.qualified_name from w join defs d on d.name = w.suffix), ended as (select w.suffix, d.qualified_name from w join defs d on ends_with(d.qualified_name, '.' || w.suffix) where not exists (select 1 from defs x where x.name = w.suffix)), hits as (select * from named union select * from ended) select suffix, list_sort(list(distinct qualified_name)) as matches from hits group by suffix")
def suffix_match(spark: SparkSession, d: str) -> DataFrame:
    """Simple-name index: a suffix is looked up by name; only names nobody has are searched as suffixes."""
    defs = cut(_defs(Graph.from_tables(spark, d)))
    parts = F.split("qualified_name", r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    wanted = defs.select(F.explode(F.array(F.element_at(parts, -1), two)).alias("suffix"))
    return names.suffix_matches(wanted, defs).groupBy("suffix").agg(F.sort_array(F.collect_set("qualified_name")).alias("matches"))


@add(f"with {_DEFS}, p as (select min(name) as p from nodes where label = 'Project') select d.node_id, d.qualified_name from defs d, p where d.qualified_name = p.p or starts_with(d.qualified_name, p.p || '.')")
def prefix_match(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    return _defs(g).where(names.has_prefix(F.col("qualified_name"), _project(g))).select("node_id", "qualified_name")


@add(f"with {_DEFS}, p as (select min(name) as p from nodes where label = 'Project') select d.node_id from defs d, p where starts_with(d.qualified_name, p.p || '.') and ends_with(d.qualified_name, '.inner')")
def prefix_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    g, qn = Graph.from_tables(spark, d), F.col("qualified_name")
    return _defs(g).where(names.has_prefix(qn, _project(g)) & names.has_suffix(qn, "inner")).select("node_id")


@add(f"with {_DEFS} select name, count(distinct qualified_name) as n from defs where name is not null group by name")
def simple_name_index(spark: SparkSession, d: str) -> DataFrame:
    return _defs(Graph.from_tables(spark, d)).where("name is not null").groupBy("name").agg(F.countDistinct("qualified_name").alias("n"))


_DISTANCE = """greatest(len(c), len(m)) - coalesce(list_position(list_transform(range(1, least(len(c), len(m)) + 1), lambda i: c[i] = m[i]), false), least(len(c), len(m)) + 1) + 1 - case when starts_with(candidate, array_to_string(m[:-2], '.') || '.') then 1 else 0 end"""
_CALLS = "calls as (select distinct a.qualified_name as caller, b.qualified_name as candidate from edges e join nodes a on a.node_id = e.from_id join nodes b on b.node_id = e.to_id where e.type = 'CALLS' and a.qualified_name is not null and b.qualified_name is not null)"


@add(f"with {_CALLS}, s as (select *, string_split(candidate, '.') as c, string_split(caller, '.') as m from calls) select caller, candidate, ({_DISTANCE})::int as distance from s")
def import_distance(spark: SparkSession, d: str) -> DataFrame:
    calls = Graph.from_tables(spark, d).cypher("MATCH (a)-[:CALLS]->(b) WHERE a.qualified_name IS NOT NULL AND b.qualified_name IS NOT NULL RETURN DISTINCT a.qualified_name AS caller, b.qualified_name AS candidate")
    return calls.select("caller", "candidate", names.import_distance(F.col("candidate"), F.col("caller")).alias("distance"))


@add(
    f"with {_CALLS}, {_DEFS}, want as (select distinct caller, split_part(candidate, '.', -1) as name from calls), cand as (select w.caller, w.name, d.qualified_name as candidate, string_split(d.qualified_name, '.') as c, string_split(w.caller, '.') as m from want w join (select distinct name, qualified_name from defs) d on d.name = w.name), r as (select caller, name, candidate, ({_DISTANCE})::int as distance from cand) select caller, name, arg_min(candidate, {{'d': distance, 'c': candidate}}) as candidate, min(distance) as distance from r group by caller, name"
)
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The nearest definition of a called name, by distance and then by name."""
    g = Graph.from_tables(spark, d)
    calls = g.cypher("MATCH (a)-[:CALLS]->(b) WHERE a.qualified_name IS NOT NULL AND b.qualified_name IS NOT NULL RETURN DISTINCT a.qualified_name AS caller, b.qualified_name AS callee")
    wanted = calls.select("caller", F.element_at(F.split("callee", r"\."), -1).alias("name")).distinct()
    return names.nearest(wanted, _defs(g).where("name is not null").select("name", "qualified_name").distinct())


_SCORED = """c as (select distinct name as class, lower(name) as b from nodes where label in ('Class', 'Interface') and name is not null and name <> ''), p as (select distinct name as param, lower(name) as a from nodes where label in ('Function', 'Method') and name is not null and name <> ''
  union select distinct lower(name), lower(name) from nodes where label = 'Class' and name is not null and name <> ''),
scored as (select param, class, case when a = b then 100 when ends_with(b, a) or ends_with(a, b) then 90 when contains(a, b) then floor(80 * (length(b) / length(a))) else 0 end::int as score from p, c)"""


def _parameters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Names as parameters' names (of functions, and of classes in small letters), and the names of classes."""
    g = Graph.from_tables(spark, d)
    classes = g.cypher("MATCH (c:Class|Interface) WHERE c.name IS NOT NULL RETURN DISTINCT c.name AS class")
    params = g.cypher("MATCH (f:Function|Method) WHERE f.name IS NOT NULL RETURN DISTINCT f.name AS param")
    own = g.cypher("MATCH (c:Class) WHERE c.name IS NOT NULL RETURN DISTINCT c.name AS param").select(F.lower("param").alias("param"))
    return params.unionByName(own), classes


@add(f"with {_SCORED} select param, class, score from scored where score > 0")
def param_name_score(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of names that score."""
    return names.scored_pairs(*_parameters(spark, d))


@add(f"with {_SCORED} select param, arg_min(class, {{'s': -score, 'c': class}}) as class, max(score) as score from scored where score > 0 group by param")
def best_param_class(spark: SparkSession, d: str) -> DataFrame:
    """The class that each name fits best."""
    return names.best_class(names.scored_pairs(*_parameters(spark, d)))


# Incremental state and caches.
@add(
    """with r as (select project, file_path, sha256(source_code) as h, epoch_us(retrieved_at) < (select (epoch_us(min(retrieved_at)) + epoch_us(max(retrieved_at))) // 2 from code_snippet) as early
  from code_snippet where label = 'Module' and source_code is not null and file_path is not null and project is not null and retrieved_at is not null),
o as (select project, file_path, min(h) as h from r where early group by project, file_path),
n as (select project, file_path, max(h) as h from r where not early group by project, file_path)
select coalesce(o.project, n.project) as project, coalesce(o.file_path, n.file_path) as file_path, case when o.h is null then 'new' when n.h is null then 'deleted' when o.h = n.h then 'unchanged' else 'changed' end as status from o full join n on o.project = n.project and o.file_path = n.file_path""",
    graph=False,
)
def hash_diff(spark: SparkSession, d: str) -> DataFrame:
    """What changed between the files retrieved in the first and in the second half of the time."""
    snippets = table(spark, d, "code_snippet")
    middle = snippets.agg(F.floor((F.unix_micros(F.min("retrieved_at")) + F.unix_micros(F.max("retrieved_at"))) / 2).alias("middle"))
    rows = snippets.where("label = 'Module' and source_code is not null and file_path is not null and project is not null and retrieved_at is not null").withColumn("sha256", incremental.content_hash(F.col("source_code")))
    rows = rows.crossJoin(F.broadcast(middle)).withColumn("early", F.unix_micros("retrieved_at") < F.col("middle"))  # one row
    old = rows.where("early").groupBy("project", "file_path").agg(F.min("sha256").alias("sha256"))
    new = rows.where("not early").groupBy("project", "file_path").agg(F.max("sha256").alias("sha256"))
    return incremental.changes(old, new, ["project", "file_path"])


@add("select sha256(text) as sha256, count(*) as n, min(doc_id) as first from documents where text is not null group by sha256(text) having count(*) > 1", graph=False)
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    return incremental.duplicates(table(spark, d, "documents"), "doc_id", "text")


@add("select n.node_id, n.qualified_name from nodes n where n.label in ('Function','Method') and n.qualified_name is not null and not exists (select 1 from embedding_cache c where c.qualified_name = n.qualified_name and c.embedding is not null)")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    expected = g.cypher("MATCH (n:Function|Method) WHERE n.qualified_name IS NOT NULL RETURN id(n) AS node_id, n.qualified_name AS qualified_name")
    store = table(spark, d, "embedding_cache").where("embedding is not null and qualified_name is not null")
    return vectors.missing(expected, store, "qualified_name").select("node_id", "qualified_name")


@add("select count(*) filter (hit) as hits, count(*) filter (not hit) as misses from (select s.snippet_id, exists (select 1 from embedding_cache c where c.content_hash = sha256(s.source_code)) as hit from code_snippet s where s.source_code is not null)", graph=False)
def embedding_cache_miss(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_snippet").where("source_code is not null").select("snippet_id", incremental.content_hash(F.col("source_code")).alias("content_hash"))
    hit, miss = incremental.cache_lookup(rows, table(spark, d, "embedding_cache").select("content_hash", "cache_id"))
    both = hit.select(F.lit(1).alias("h"), F.lit(0).alias("m")).unionAll(miss.select(F.lit(0).alias("h"), F.lit(1).alias("m")))
    return both.agg(F.coalesce(F.sum("h"), F.lit(0)).cast("bigint").alias("hits"), F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("misses"))


_QUERY_VECTOR = [((i * 37) % 101 - 50) / 50 for i in range(64)]
_QUERY_SQL = "[" + ", ".join(f"{x}::double" for x in _QUERY_VECTOR) + "]"


@add(f"select vec_id, round(list_cosine_similarity(embedding::double[], {_QUERY_SQL}), 6) as score from embeddings order by list_cosine_similarity(embedding::double[], {_QUERY_SQL}) desc, vec_id limit 20", graph=False)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    found = vector.top_k(table(spark, d, "embeddings"), "vec_id", "embedding", _QUERY_VECTOR, 20)
    return found.select("vec_id", F.round("score", 6).alias("score"))


_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
_BLANKS = "' ' || " + " || ".join(f"chr({c})" for c in (9, 10, 13, 11, 12, 28, 29, 30, 31, 133, 160, 8232, 8233))


@add(f"with s as (select snippet_id, regexp_extract_all(source_code, '(?s).*?(?:{_ENDS})|.+$') as l from code_snippet where source_code is not null) select snippet_id, case when len(l) >= 3 then trim(array_to_string(l[3:7], ''), {_BLANKS}) end as part from s", graph=False)
def line_slice(spark: SparkSession, d: str) -> DataFrame:
    """Lines 3 to 7 of each snippet, whatever its line ends; null where there is no line 3."""
    rows = table(spark, d, "code_snippet").where("source_code is not null")
    return rows.select("snippet_id", text.slice_lines(F.col("source_code"), F.lit(3), F.lit(7)).alias("part"))


# Debounced events.
@add(
    """with ordered as (select user_id as path, epoch_us(ts) as t, event_type, event_id, row_number() over (partition by user_id order by ts, event_id) as i from events where user_id is not null and ts is not null),
fold as (select path, i, t, event_type as k, t as first, t as last, 1 as n, 1 as round, event_id from ordered where i = 1
  union all select o.path, o.i, o.t, o.event_type, case when o.t >= least(f.last + 21600000000, f.first + 86400000000) then o.t else f.first end, o.t,
    case when o.t >= least(f.last + 21600000000, f.first + 86400000000) then 1 else f.n + 1 end, case when o.t >= least(f.last + 21600000000, f.first + 86400000000) then f.round + 1 else f.round end, o.event_id
  from fold f join ordered o on o.path = f.path and o.i = f.i + 1),
ends as (select path, round, max(i) as i from fold group by path, round)
select f.path, make_timestamp(least(f.last + 21600000000, f.first + 86400000000)) as fired_at, f.k as event_type, f.n::bigint as n_events, make_timestamp(f.first) as first_at from fold f join ends e on e.path = f.path and e.round = f.round and e.i = f.i""",
    graph=False,
)
def debounce_batch(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumnRenamed("user_id", "path")
    return debounce.debounce_batch(events, 6 * 3600, 24 * 3600, tie="event_id")



# Extraction and resolution.
def _files(spark: SparkSession, d: str) -> DataFrame:
    """The latest text of each file that was retrieved whole."""
    rows = table(spark, d, "code_snippet").where("label = 'Module' and found and project is not null and file_path is not null and source_code is not null")
    return rows.groupBy("project", F.col("file_path").alias("path")).agg(F.max_by("source_code", F.struct("retrieved_at", "snippet_id")).alias("content"))


@add()
def extract_definitions(spark: SparkSession, d: str) -> DataFrame:
    found = extract.facts(_files(spark, d)).where("fact = 'definition'")
    return found.select("project", "path", "label", "qualified_name", "name", "parent", "parent_label", "start_line", "end_line", "docstring", "decorators", "is_exported")


@add()
def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    return resolve.import_targets(resolve.Facts(extract.facts(_files(spark, d))))


@add()
def resolve_inheritance(spark: SparkSession, d: str) -> DataFrame:
    return resolve.parents(resolve.Facts(extract.facts(_files(spark, d))))


@add()
def resolve_overrides(spark: SparkSession, d: str) -> DataFrame:
    f = resolve.Facts(extract.facts(_files(spark, d)))
    return resolve.overrides(f, cut(resolve.parents(f)))


@add()
def resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    f = resolve.Facts(extract.facts(_files(spark, d)))
    return resolve.resolve_calls(f, cut(resolve.parents(f)))


_DIRS = """f as (select distinct project, file_path as path from code_snippet where project is not null and file_path is not null),
d as (select project, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, split_part(path, '/', -1) as name from f where contains(path, '/')),
tree as (select distinct project, dir from d where dir <> '' union select project, regexp_extract(dir, '^(.*)/[^/]*$', 1) from tree where contains(dir, '/'))"""


@add(
    f"""with {_DIRS}, marked as (select project, dir, bool_or(name in ({", ".join(f"'{x}'" for x in PACKAGE_FILES)})) as package from d group by project, dir),
k as (select t.project, t.dir, case when coalesce(m.package, false) then 'Package' else 'Folder' end as label from tree t left join marked m on m.project = t.project and m.dir = t.dir),
x as (select project, label, dir as path from k union all select project, 'File', path from f)
select project, label, path, split_part(path, '/', -1) as name from x union all select distinct project, 'Project', null, project from f""",
    graph=False,
)
def directory_structure(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "code_snippet").select("project", F.col("file_path").alias("path"))
    return repository.structure(files).select("project", "label", "path", "name")


@add("select s.snippet_id, case lower(regexp_extract(file_path, '^.*[^/](\\.[^./]+)$', 1)) when '.py' then 'python' when '.js' then 'javascript' when '.ts' then 'typescript' when '.java' then 'java' when '.go' then 'go' when '.lua' then 'lua' end as language from code_snippet s where file_path is not null", graph=False)
def language_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_snippet").where("file_path is not null").select("snippet_id", repository.language(F.col("file_path")).alias("language"))


@add("select count(*) as total_nodes, (select count(*) from edges) as total_relationships, length((select string_agg(node_id::varchar, '') from nodes))::bigint as id_characters from nodes")
def json_export_counts(spark: SparkSession, d: str) -> DataFrame:
    """The whole graph as the lines of one JSON document, read back."""
    lines = repository.document_lines(Graph.from_tables(spark, d))
    node = F.when(F.col("section") == 1, F.from_json(F.ltrim(F.col("line"), F.lit(",")), "node_id bigint"))
    counts = F.when(F.col("section") == 4, F.from_json(F.regexp_replace("line", r"^\],", "{"), "metadata struct<total_nodes:bigint,total_relationships:bigint>"))
    back = lines.select(node.alias("node"), counts["metadata"].alias("counts"))
    total = lambda name: F.max(F.col("counts")[name]).alias(name)
    return back.agg(total("total_nodes"), total("total_relationships"), F.sum(F.length(F.col("node.node_id").cast("string"))).alias("id_characters"))


@add("select v.vec_id, v.label from embeddings v where v.vec_id % 10 <> 0 or v.vec_id % 20 = 0", graph=False)
def vector_upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    """A store without every tenth vector, into which every twentieth is put back."""
    every = table(spark, d, "embeddings")
    store = vectors.delete(every, every.where("vec_id % 10 = 0"), "vec_id")
    return vectors.upsert(store, every.where("vec_id % 20 = 0"), "vec_id").select("vec_id", "label")


@add("with q as (select embedding from embedding_cache where embedding is not null and len(embedding) = 768 and qualified_name is not null and not list_bool_or(list_transform(embedding, lambda x: isnan(x))) and list_sum(list_transform(embedding, lambda x: abs(x))) > 0 order by cache_id limit 1), s as (select c.cache_id, c.qualified_name, list_cosine_similarity(c.embedding::double[], q.embedding::double[]) as score from embedding_cache c, q where c.embedding is not null and len(c.embedding) = 768), t as (select * from s where score is not null and not isnan(score) order by score desc, cache_id limit 25) select t.cache_id, t.qualified_name, round(t.score, 3) as score from t", graph=False)
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "embedding_cache")
    good = cache.where("embedding is not null and size(embedding) = 768 and qualified_name is not null and not exists(embedding, x -> isnan(x)) and exists(embedding, x -> x <> 0)")
    wanted = good.orderBy("cache_id").select("embedding").first()
    best = vector.top_k(cache, "cache_id", "embedding", list(wanted[0]) if wanted else [0.0] * 768, 25)
    return cache.join(F.broadcast(best), "cache_id").select("cache_id", "qualified_name", F.bround("score", 3).alias("score"))


# More of the statements that the reference's tools issue.
cypher("embedding_candidates", "MATCH (m:Module)-[:DEFINES]->(n) WHERE (n:Function OR n:Method) RETURN id(n) AS node_id, n.qualified_name AS qualified_name, n.start_line AS start_line, m.path AS path ORDER BY n.qualified_name", "select n.node_id, n.qualified_name, n.start_line, m.path from edges e join nodes m on m.node_id = e.from_id join nodes n on n.node_id = e.to_id where e.type = 'DEFINES' and m.label = 'Module' and n.label in ('Function','Method')")
cypher("source_location", "MATCH (m:Module)-[:DEFINES]->(n) WHERE id(n) IN $ids RETURN n.qualified_name AS qualified_name, n.start_line AS start_line, m.path AS path", "select n.qualified_name, n.start_line, m.path from edges e join nodes m on m.node_id = e.from_id join nodes n on n.node_id = e.to_id where e.type = 'DEFINES' and m.label = 'Module' and n.node_id between 3000 and 4000", ids=list(range(3000, 4001)))
cypher("exported_functions", "MATCH (n:Function|Method) WHERE n.is_exported = 'true' AND toLower(n.name) CONTAINS 'e' RETURN n.name AS name, n.qualified_name AS qualified_name, labels(n) AS type", "select name, qualified_name, [label] as type from nodes where label in ('Function','Method') and is_exported = 'true' and contains(lower(name), 'e')")
cypher("all_file_paths", "MATCH (f:File) RETURN f.path AS path, f.project AS project", "select path, project from nodes where label = 'File'")
cypher("module_paths", "MATCH (m:Module) WHERE m.is_external IS NULL OR m.is_external = 'false' RETURN m.path AS path, m.qualified_name AS qualified_name", "select path, qualified_name from nodes where label = 'Module'")
cypher("folder_paths", "MATCH (f:Folder) RETURN f.path AS path", "select path from nodes where label = 'Folder'")
cypher("external_dependencies", "MATCH (p)-[r:DEPENDS_ON_EXTERNAL]->(x:ExternalPackage) RETURN id(p) AS project_id, x.name AS package, r.version_spec AS spec", "select p.node_id as project_id, x.name as package, e.version_spec as spec from edges e join nodes p on p.node_id = e.from_id join nodes x on x.node_id = e.to_id where e.type = 'DEPENDS_ON_EXTERNAL' and x.label = 'ExternalPackage'")
cypher("regex_match", "MATCH (n:Class) WHERE n.name =~ '[A-M].*(Node|Store|Cache)' RETURN id(n) AS node_id, n.name AS name", "select node_id, name from nodes where label = 'Class' and regexp_full_match(name, '[A-M].*(Node|Store|Cache)')")
cypher("callers_of_popular", "MATCH (a)-[:CALLS]->(b) WITH b, count(a) AS callers WHERE callers > 8 MATCH (m)-[:DEFINES]->(b) RETURN id(b) AS node_id, callers, m.qualified_name AS module", "with c as (select b.node_id, count(*) as callers from edges e join nodes a on a.node_id = e.from_id join nodes b on b.node_id = e.to_id where e.type = 'CALLS' group by b.node_id having count(*) > 8) select c.node_id, c.callers, m.qualified_name as module from c join edges e on e.to_id = c.node_id and e.type = 'DEFINES' join nodes m on m.node_id = e.from_id")


@add("with p as (select min(name) as p from nodes where label = 'Project') select n.node_id from edges e join nodes m on m.node_id = e.from_id join nodes n on n.node_id = e.to_id, p where e.type = 'DEFINES' and m.label = 'Module' and n.label in ('Function','Method') and starts_with(m.qualified_name, p.p || '.')")
def project_node_ids(spark: SparkSession, d: str) -> DataFrame:
    g = Graph.from_tables(spark, d)
    text_ = "MATCH (m:Module)-[:DEFINES]->(n) WHERE (n:Function OR n:Method) AND m.qualified_name STARTS WITH $prefix RETURN id(n) AS node_id"
    return g.cypher(text_, prefix=_project(g) + ".")


@add(
    "with live as (select e.* from edges e join nodes a on a.node_id = e.from_id join nodes b on b.node_id = e.to_id), u as (select from_id as s, to_id as t from live union select to_id, from_id from live), near(id, source, n) using key (id) as (select node_id, node_id, 0 from nodes where label = 'Module' union select u.t, min(x.source), min(x.n) + 1 from near x join u on u.s = x.id where not exists (select 1 from recurring.near k where k.id = u.t) group by u.t) select w.node_id, w.qualified_name, m.source as module_id, m.n::int as hops from nodes w left join near m on m.id = w.node_id where w.label in ('Function', 'Method') and w.qualified_name is not null"
)
def find_with_module(spark: SparkSession, d: str) -> DataFrame:
    """Every function and method with the nearest module."""
    g = Graph.from_tables(spark, d)
    wanted = g.cypher("MATCH (n:Function|Method) WHERE n.qualified_name IS NOT NULL RETURN DISTINCT n.qualified_name AS qualified_name")
    own = g.labelled("Function", "Method").select("node_id")
    return g.find(wanted).join(own, "node_id", "left_semi").select("node_id", "qualified_name", "module_id", F.col("hops").cast("int").alias("hops"))


@add("with live as (select e.* from edges e join nodes a on a.node_id = e.from_id join nodes b on b.node_id = e.to_id), h as (select node_id as id from nodes where label = 'Project' and name = (select max(name) from nodes where label = 'Project') union select e.to_id from h join live e on e.from_id = h.id and e.type in ('CONTAINS_PACKAGE','CONTAINS_FOLDER','CONTAINS_FILE','CONTAINS_MODULE')), p as (select node_id as id from nodes where label = 'Project' and name = (select max(name) from nodes where label = 'Project')), first as (select distinct e.to_id as id from h join live e on e.from_id = h.id and e.type in ('DEFINES','DEFINES_METHOD') where h.id not in (select id from p)), g as (select id from first union select e.to_id from g join live e on e.from_id = g.id and e.type in ('DEFINES','DEFINES_METHOD')), gone as (select id from h union select id from g) select count(*) as left_nodes, (select count(*) from edges where from_id not in (select id from gone) and to_id not in (select id from gone)) as left_edges from nodes where node_id not in (select id from gone)")
def delete_project_statement(spark: SparkSession, d: str) -> DataFrame:
    """The reference's own statement, run as text."""
    g = Graph.from_tables(spark, d)
    name = g.labelled("Project").agg(F.max(F.try_element_at("properties", F.lit("name")))).first()[0] or ""
    statement = "MATCH (p:Project {name: $project_name}) OPTIONAL MATCH (p)-[:CONTAINS_PACKAGE|CONTAINS_FOLDER|CONTAINS_FILE|CONTAINS_MODULE*]->(container) OPTIONAL MATCH (container)-[:DEFINES|DEFINES_METHOD*]->(defined) DETACH DELETE p, container, defined"
    left, _ = g.execute(statement, project_name=name)
    return left.nodes.agg(F.count("*").alias("left_nodes")).join(F.broadcast(left.edges.agg(F.count("*").alias("left_edges"))))


@add(f"with s as (select snippet_id, string_split_regex(source_code, '{_ENDS}') as l, source_code from code_snippet where source_code is not null), t as (select snippet_id, case when source_code = '' then [] when l[-1] = '' then l[:-2] else l end as l from s) select snippet_id, '11..' || least(len(l), 15) || ' of ' || len(l) as head, array_to_string(l[11:15], '|') as page from t", graph=False)
def paginated_read(spark: SparkSession, d: str) -> DataFrame:
    """Five lines from the eleventh of each snippet, with the header that says which."""
    rows = table(spark, d, "code_snippet").where("source_code is not null").select("snippet_id", text.page(F.col("source_code"), 10, 5).alias("p"))
    return rows.select("snippet_id", F.concat("p.first", F.lit(".."), "p.last", F.lit(" of "), "p.total").alias("head"), F.array_join("p.lines", "|").alias("page"))


@add("select distinct name, array_to_string(list_transform(string_split(name, '_'), lambda x: upper(x[1]) || lower(x[2:])), '') as camel, split_part(regexp_replace(qualified_name, ':', '.', 'g'), '.', -1) as last from nodes where label = 'Function' and name is not null and qualified_name is not null")
def name_scalars(spark: SparkSession, d: str) -> DataFrame:
    rows = Graph.from_tables(spark, d).cypher("MATCH (f:Function) WHERE f.name IS NOT NULL AND f.qualified_name IS NOT NULL RETURN f.name AS name, f.qualified_name AS qn")
    return rows.select("name", names.camel(F.col("name")).alias("camel"), names.last_part(F.col("qn")).alias("last")).distinct()


# Spelling, ranking and presentation.
_LANGUAGES = ["javascript", "rust", "cpp", "go", "java", "lua", "python"]
_SPELT = f"""spelt as (select distinct qualified_name as dotted, lang, replace(qualified_name, '.', case lang when 'go' then '/' when 'rust' then '::' when 'cpp' then '::' else '.' end) as full_name
  from (select case when i = 1 then 'std.' || qualified_name else qualified_name end as qualified_name from nodes, (select unnest([0, 1]) as i) where qualified_name is not null), (select unnest({_LANGUAGES}) as lang))"""


@add(
    f"with {_SPELT}, x as (select full_name, lang, case lang when 'go' then '/' when 'rust' then '::' when 'cpp' then '::' else '.' end as mark from spelt), y as (select *, split_part(full_name, mark, -1) as last from x), z as (select *, regexp_matches(last, '^[A-Z]') as capital from y) select full_name, lang, case when contains(full_name, mark) and (case lang when 'javascript' then true when 'rust' then capital or (upper(last) = last and regexp_matches(last, '[A-Za-z]')) or (lower(last) = last and regexp_matches(last, '[a-z]') and not contains(last, '_')) when 'cpp' then starts_with(full_name, 'std::') and (capital or regexp_matches(last, '^(is_|has_)') or last in {tuple(modules.CPP_ENTITIES)}) when 'java' then capital or regexp_matches(last, '(Exception|Error|Interface|Builder)$') when 'lua' then capital or last in {tuple(modules.LUA_MODULES)} else capital end) then left(full_name, length(full_name) - length(last) - length(mark)) else full_name end as module from z"
)
def import_modules(spark: SparkSession, d: str) -> DataFrame:
    """The module that each name, spelt as in each language, belongs to."""
    g = Graph.from_tables(spark, d)
    rows = g.cypher("MATCH (n) WHERE n.qualified_name IS NOT NULL RETURN DISTINCT n.qualified_name AS dotted")
    rows = rows.select(F.explode(F.array("dotted", F.concat(F.lit("std."), "dotted"))).alias("dotted")).select("dotted", F.explode(F.array(*map(F.lit, _LANGUAGES))).alias("lang"))
    mark = F.when(F.col("lang") == "go", "/").when(F.col("lang").isin("rust", "cpp"), "::").otherwise(".")
    rows = rows.select("lang", F.replace("dotted", F.lit("."), mark).alias("full_name")).distinct()
    return rows.select("full_name", "lang", modules.entity_module(F.col("full_name"), F.col("lang")).alias("module"))


_RANKED = """m as (select qualified_name as candidate, array_to_string(string_split(qualified_name, '.')[2:], '.') as path, name from nodes where label = 'Module' and qualified_name is not null),
k as (select distinct qualified_name as class, split_part(qualified_name, '.', -2) as n, regexp_replace(qualified_name, '\\.[^.]*$', '') as module from nodes where label = 'Class' and contains(qualified_name, '.')),
c as (select distinct k.class, k.module, m.candidate, m.path from k join m on split_part(m.candidate, '.', -1) = k.n)"""


@add(
    f"with {_RANKED}, p as (select *, string_split(candidate, '.') as a, string_split(module, '.') as b from c), q as (select *, coalesce((select min(i) from range(1, least(len(a), len(b)) + 1) r(i) where a[i] <> b[i]), least(len(a), len(b)) + 1) - 1 as common from p), s as (select *, case when path = class then 0 when path <> '' and ends_with(class, path) then 1 else 2 end as penalty, greatest(greatest(len(a), len(b)) - common - case when len(b) > 1 and starts_with(candidate, regexp_replace(module, '\\.[^.]*$', '') || '.') then 1 else 0 end, 0) as distance from q) select class, module, candidate, row_number() over (partition by class, module order by penalty, distance, candidate)::int as place from s"
)
def module_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The modules named like a class's own, in the order in which they are tried for it."""
    g = Graph.from_tables(spark, d)
    found = g.cypher("MATCH (m:Module) WHERE m.qualified_name IS NOT NULL RETURN DISTINCT m.qualified_name AS candidate")
    parts = F.split("candidate", r"\.")
    found = found.select("candidate", F.element_at(parts, -1).alias("n"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), ".").alias("path"), F.col("candidate").alias("ord"))
    classes = g.cypher("MATCH (c:Class) WHERE c.qualified_name CONTAINS '.' RETURN DISTINCT c.qualified_name AS class")
    classes = classes.select("class", F.get(F.split("class", r"\."), F.size(F.split("class", r"\.")) - 2).alias("n"), names.owner(F.col("class")).alias("module"))
    return resolve.ranked_modules(classes.join(found, "n")).select("class", "module", "candidate", F.col("place").cast("int").alias("place"))


@add(f"with called as (select distinct name as call from nodes where label in ('Function', 'Method') and name is not null union select distinct name || '.' || m from nodes, (select unnest(['bind', 'call', 'apply', 'keys']) as m) where label = 'Class' and name is not null union select unnest({resolve.SCRIPT_BUILTINS})) select call, case when call in {tuple(resolve.SCRIPT_BUILTINS)} then 'builtin.' || call when contains(call, '.') and split_part(call, '.', -1) in ('bind', 'call', 'apply') then 'builtin.Function.prototype.' || split_part(call, '.', -1) end as target from called")
def builtin_calls(spark: SparkSession, d: str) -> DataFrame:
    """What calls without a definition mean in JavaScript."""
    g = Graph.from_tables(spark, d)
    plain = g.cypher("MATCH (n:Function|Method) WHERE n.name IS NOT NULL RETURN DISTINCT n.name AS name").withColumnRenamed("name", "call")
    own = g.cypher("MATCH (n:Class) WHERE n.name IS NOT NULL RETURN DISTINCT n.name AS name").select(F.explode(F.transform(F.array(*map(F.lit, [*resolve.FUNCTION_METHODS, "keys"])), lambda m: F.concat_ws(".", F.col("name"), m))).alias("call"))
    given = spark.createDataFrame([(x,) for x in resolve.SCRIPT_BUILTINS], "call string")
    return plain.unionByName(own).unionByName(given).distinct().withColumn("target", resolve.builtin_target(F.col("call")))


@add("select node_id, '{\"node_id\": ' || node_id || ', \"label\": ' || to_json(label)::varchar || ', \"path\": ' || coalesce(to_json(path)::varchar, 'null') || '}' as row from nodes where label is not null")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Result rows as the text whose tokens are counted."""
    rows = Graph.from_tables(spark, d).cypher("MATCH (n) RETURN id(n) AS node_id, labels(n)[0] AS label, n.path AS path").where("label is not null")
    return rows.select("node_id", text.json_row(rows).alias("row"))


@add("select coalesce(snippet_id::varchar, '') as snippet_id, coalesce(project, '') as project, case found when true then '✓' when false then '✗' else '' end as found, coalesce(line_start::varchar, '') as line_start from code_snippet", graph=False)
def shown_rows(spark: SparkSession, d: str) -> DataFrame:
    """Result rows as they stand in a table for people."""
    return text.shown(table(spark, d, "code_snippet").select("snippet_id", "project", "found", "line_start"))


@add("select n.node_id, regexp_extract(n.qualified_name || '().' || n.name, '\\.([^.()]+)$', 1) as method, regexp_extract(n.qualified_name || '()', '\\.([^.()]+)$', 1) as none from nodes n where n.qualified_name is not null and n.name is not null")
def chained_methods(spark: SparkSession, d: str) -> DataFrame:
    rows = Graph.from_tables(spark, d).cypher("MATCH (n) WHERE n.qualified_name IS NOT NULL AND n.name IS NOT NULL RETURN id(n) AS node_id, n.qualified_name AS q, n.name AS name")
    return rows.select("node_id", text.method_of_chain(F.concat("q", F.lit("()."), "name")).alias("method"), text.method_of_chain(F.concat("q", F.lit("()"))).alias("none"))


@add("with v as (select project, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embedding_cache where embedding is not null and len(embedding) = 768 and qualified_name is not null and project is not null), m as (select project, pos, avg(x::double) as x from v group by project, pos) select project, list(round(x, 6) order by pos) as pooled from m where project in (select project from m group by project having not bool_or(isnan(x))) group by project", graph=False)
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the named vectors of each project, as a model pools the tokens that are not padding."""
    rows = table(spark, d, "embedding_cache").where("size(embedding) = 768 and project is not null")
    pooled = vector.mean_pool(rows.withColumn("used", F.col("qualified_name").isNotNull()), ["project"], "embedding", "used")
    return pooled.where(~F.exists("pooled", F.isnan)).select("project", F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"))


@add("with e as (select distinct qualified_name from nodes where label in ('Function','Method') and qualified_name is not null), m as (select qualified_name from e where qualified_name not in (select qualified_name from embedding_cache where embedding is not null and qualified_name is not null)) select (select count(*) from e) as n_expected, (select count(*) from m) as n_missing, (select list(qualified_name order by qualified_name) from (select qualified_name from m order by qualified_name limit 10)) as sample")
def embedding_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """How many functions have no vector, and the first ten of them."""
    expected = Graph.from_tables(spark, d).cypher("MATCH (n:Function|Method) WHERE n.qualified_name IS NOT NULL RETURN DISTINCT n.qualified_name AS qualified_name")
    return incremental.reconcile(expected, table(spark, d, "embedding_cache").where("embedding is not null and qualified_name is not null"), "qualified_name")
