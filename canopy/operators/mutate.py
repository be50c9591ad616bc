"""Writes on the graph, as new snapshots.

Nodes are told apart by label and key; a node's id is the hash of both, so that it is the same in every run. Properties are
staged as rows (`label`, `key`, `property`, `value`, `seq`); a null value removes the property.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy import schema
from canopy.graph import Graph
from canopy.operators.traverse import reach_set
from canopy.session import cut


def node_id(label: Column, key: Column) -> Column:
    return F.xxhash64(label, key)


def key_column(properties: str = "properties", labels: str = "labels") -> Column:
    """A node's unique key by its first label."""
    label, out = F.try_element_at(labels, F.lit(1)), None
    for name, key in schema.KEYS.items():
        test = label == name
        value = F.try_element_at(properties, F.lit(key))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def merge_properties(staging: DataFrame) -> DataFrame:
    """(`label`, `key`, `property`, `value`): the last value of each property by `seq`; those last set to null are gone.

    Of two values with one `seq` the greater wins, and a value wins over null. Rows without label or key are left out.
    """
    rows = staging.where("label is not null and key is not null and property is not null").repartition("label", "key")
    last = F.max(F.struct("seq", F.col("value").isNotNull().alias("set"), "value")).getField("value")
    return rows.groupBy("label", "key", "property").agg(last.alias("value")).where("value is not null")


def staged(nodes: DataFrame, seq: int = -1) -> DataFrame:
    """The rows of a snapshot as staging, before all others."""
    return nodes.select(F.try_element_at("labels", F.lit(1)).alias("label"), key_column().alias("key"), F.explode("properties").alias("property", "value")).withColumn("seq", F.lit(seq).cast("bigint"))


def merge_nodes(graph: Graph, staging: DataFrame) -> Graph:
    """MERGE by label and key with SET +=: last value wins in order of `seq`, null removes. The key itself always stays."""
    merged = merge_properties(staged(graph.nodes).unionByName(staging.select("label", "key", "property", "value", "seq")))
    made = merged.groupBy("label", "key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("property", "value")))).alias("properties"))
    old = graph.nodes.select(F.col("node_id"), F.col("project"), F.try_element_at("labels", F.lit(1)).alias("label"), key_column().alias("key"))
    nodes = made.join(old, ["label", "key"], "left").select(F.coalesce("node_id", node_id(F.col("label"), F.col("key"))).alias("node_id"), F.array("label").alias("labels"), "properties", "project")
    return Graph(nodes, graph.edges)


def with_endpoints(staging: DataFrame, nodes: DataFrame) -> DataFrame:
    """Staged edges (`from_label`, `from_key`, `type`, `to_label`, `to_key`, ...) with `from_id` and `to_id`.

    An edge whose ends don't both exist under their labels is left out.
    """
    known = nodes.select(F.try_element_at("labels", F.lit(1)).alias("label"), key_column().alias("key"), "node_id").where("key is not null")
    end = lambda e: known.select(F.col("label").alias(f"{e}_label"), F.col("key").alias(f"{e}_key"), F.col("node_id").alias(f"{e}_id"))
    return staging.join(end("from"), ["from_label", "from_key"]).join(end("to"), ["to_label", "to_key"])


def merge_edges(graph: Graph, staging: DataFrame) -> Graph:
    """MERGE of edges: one for each pair of ends and type; properties are merged, the last value wins in order of `seq`."""
    found = with_endpoints(staging, graph.nodes)
    stage = found.select("from_id", "to_id", "type", "properties", "seq").unionByName(graph.edges.select("from_id", "to_id", "type", "properties").withColumn("seq", F.lit(-1).cast("bigint")))
    values = stage.select("from_id", "to_id", "type", "seq", F.explode_outer("properties").alias("property", "value"))
    last = values.groupBy("from_id", "to_id", "type", "property").agg(F.max(F.struct("seq", F.col("value").isNotNull().alias("set"), "value")).getField("value").alias("value"))
    entries = F.sort_array(F.collect_list(F.when(F.col("property").isNotNull() & F.col("value").isNotNull(), F.struct("property", "value"))))
    edges = last.groupBy("from_id", "to_id", "type").agg(F.map_from_entries(entries).alias("properties"))
    old = graph.edges.groupBy("from_id", "to_id", "type").agg(F.min("rel_id").alias("rel_id"))
    edges = edges.join(old, ["from_id", "to_id", "type"], "left").select(F.coalesce("rel_id", F.xxhash64("from_id", "to_id", "type")).alias("rel_id"), "from_id", "to_id", "type", "properties")
    return Graph(graph.nodes, edges)


def create_nodes(graph: Graph, rows: DataFrame) -> Graph:
    """CREATE: rows (`label`, `properties`, `seq`) as they come, without a look at what exists."""
    made = rows.select(F.xxhash64("label", F.map_entries("properties").cast("string"), "seq").alias("node_id"), F.array("label").alias("labels"), "properties", F.lit(None).cast("string").alias("project"))
    return Graph(graph.nodes.unionByName(made), graph.edges)


def create_edges(graph: Graph, staging: DataFrame) -> Graph:
    """CREATE of edges: as `merge_edges`, but repeated rows make repeated edges."""
    made = with_endpoints(staging, graph.nodes).select(F.xxhash64("from_id", "to_id", "type", "seq").alias("rel_id"), "from_id", "to_id", "type", "properties")
    return Graph(graph.nodes, graph.edges.unionByName(made))


def violations(nodes: DataFrame) -> DataFrame:
    """(`label`, `key`, `n`) of keys that more than one node has."""
    keyed = nodes.select(F.try_element_at("labels", F.lit(1)).alias("label"), key_column().alias("key")).where("key is not null")
    return keyed.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")


def detach(graph: Graph, ids: DataFrame) -> Graph:
    """The graph without the nodes `ids` (`id`) and the edges at them."""
    ids = cut(ids.select("id").distinct())
    nodes = graph.nodes.join(ids, F.col("node_id") == F.col("id"), "left_anti")
    edges = graph.edges.join(ids, F.col("from_id") == F.col("id"), "left_anti").join(ids, F.col("to_id") == F.col("id"), "left_anti")
    return Graph(nodes, edges)


def delete_all(graph: Graph, confirm: bool) -> Graph:
    if not confirm:
        raise ValueError("deleting the whole graph needs confirm=True")
    return Graph(graph.nodes.limit(0), graph.edges.limit(0))


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("node_id").alias("id"))


def project_ids(graph: Graph, name: str) -> DataFrame:
    """Ids of a project node, of all its containers, and of all that these define."""
    start = _ids(graph.labelled("Project").where(F.try_element_at("properties", F.lit("name")) == name))
    holders = reach_set(start, graph.steps("CONTAINS_PACKAGE", "CONTAINS_FOLDER", "CONTAINS_FILE", "CONTAINS_MODULE"))
    return reach_set(holders, graph.steps("DEFINES", "DEFINES_METHOD"))


def delete_project(graph: Graph, name: str) -> Graph:
    return detach(graph, project_ids(graph, name))


def module_closure(graph: Graph, path: str) -> DataFrame:
    """Ids of the modules with a path and of all that edges of any type lead to from them."""
    return reach_set(_ids(graph.labelled("Module").where(F.try_element_at("properties", F.lit("path")) == path)), graph.steps())


def delete_module(graph: Graph, path: str) -> Graph:
    return detach(graph, module_closure(graph, path))


def delete_path(graph: Graph, label: str, path: str) -> Graph:
    """DETACH DELETE of the files or folders with a path, in every project."""
    return detach(graph, _ids(graph.labelled(label).where(F.try_element_at("properties", F.lit("path")) == path)))


def delete_edges(graph: Graph, kind: str) -> Graph:
    return Graph(graph.nodes, graph.edges.where(F.col("type").isNull() | (F.col("type") != kind)))


def orphans(nodes: DataFrame, listing: DataFrame, project: str | None = None) -> DataFrame:
    """Nodes of files, folders and internal modules whose path isn't in the listing (`project`, `path`) any more."""
    path = F.try_element_at("properties", F.lit("path"))
    external = F.coalesce(F.lower(F.try_element_at("properties", F.lit("is_external"))) == "true", F.lit(False))
    held = nodes.where(F.arrays_overlap("labels", F.array(F.lit("File"), F.lit("Folder"), F.lit("Module"))) & path.isNotNull() & ~external).withColumn("path", path)
    if project is not None:
        held = held.where(F.col("project") == project)
    return held.join(listing.select("project", "path").distinct(), ["project", "path"], "left_anti")


def first_wins(staging: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by `seq`, as the file sink keeps nodes."""
    rest = [c for c in staging.columns if c not in keys]
    first = F.min(F.struct(seq, *(c for c in rest if c != seq))).alias("_r")
    return staging.groupBy(*keys).agg(first).select(*keys, "_r.*")


def batches(staging: DataFrame, required: list[str], accepted: Callable[[DataFrame], DataFrame] = lambda x: x) -> tuple[DataFrame, DataFrame]:
    """Rows that have all required values, and the rejected ones."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return accepted(staging.where(ok)), staging.where(~ok)
