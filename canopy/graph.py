"""The property graph: a table of nodes and one of edges, and the reads on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy import schema
from canopy.operators.hierarchy import edge_type
from canopy.session import table


def last_wins(values: str, order: str, least: str = "''") -> Column:
    """The value with the greatest `order`, the greater one at ties; null values don't count."""
    return F.max(F.when(F.col(values).isNotNull(), F.struct(F.col(order), F.col(values)))).getField(values)


@dataclass(frozen=True)
class Graph:
    """`nodes` (`node_id`, `labels`, `properties`, `project`), `edges` (`rel_id`, `from_id`, `to_id`, `type`, `properties`)."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def from_tables(spark: SparkSession, d: str) -> Graph:
        """The living graph of the node, shared-node and relationship tables."""
        rows = table(spark, d, "graph_node").unionByName(table(spark, d, "shared_node"))
        return Graph(current_nodes(rows), stored_edges(table(spark, d, "graph_relationship")))

    def labelled(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))

    def steps(self, *types: str) -> DataFrame:
        """Edges as (`src`, `dst`), of the given types or all."""
        edges = self.edges.where(F.col("type").isin(*types)) if types else self.edges
        return edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))

    def by_property(self, name: str, value: str) -> DataFrame:
        """Nodes whose property has the value; nodes without it never match."""
        return self.nodes.where(F.try_element_at("properties", F.lit(name)) == value)

    def relationships(self, ids: DataFrame) -> DataFrame:
        """Edges at the nodes `ids` (`id`): outgoing and then incoming ones, so a loop comes twice."""
        out = self.edges.join(ids, F.col("from_id") == F.col("id"), "left_semi").withColumn("direction", F.lit("outgoing"))
        return out.unionByName(self.edges.join(ids, F.col("to_id") == F.col("id"), "left_semi").withColumn("direction", F.lit("incoming")))

    def summary(self) -> DataFrame:
        """(`kind`, `name`, `n`): nodes per label, once for each of their labels, and edges per type."""
        labels = self.nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), "name", "n")
        return labels.unionByName(self.edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "name", "n"))

    def with_endpoints(self) -> Graph:
        """Only the edges whose two ends exist."""
        ids = self.nodes.select("node_id")
        edges = self.edges.join(ids, F.col("from_id") == F.col("node_id"), "left_semi").join(ids, F.col("to_id") == F.col("node_id"), "left_semi")
        return Graph(self.nodes, edges)

    def find(self, names: DataFrame) -> DataFrame:
        """Nodes with the qualified `names` (`qualified_name`) and the nearest module, over edges of any type and direction.

        Of several at one distance the module with the smallest id is taken; a module itself has none.
        """
        from canopy.operators.traverse import both_ways, nearest_sources

        qn = F.try_element_at("properties", F.lit("qualified_name")).alias("qualified_name")
        wanted = self.nodes.select("node_id", qn, F.try_element_at("properties", F.lit("name")).alias("name"), F.try_element_at("properties", F.lit("path")).alias("own_path")).join(names.select("qualified_name").distinct(), "qualified_name", "left_semi")
        modules = self.labelled("Module").select(F.col("node_id").alias("id"), F.try_element_at("properties", F.lit("path")).alias("module_path"))
        found = nearest_sources(modules, both_ways(self.with_endpoints().steps())).where("hops > 0")
        near = found.withColumnRenamed("id", "node_id").join(modules, F.col("source") == F.col("id")).select("node_id", F.col("source").alias("module_id"), "module_path", "hops")
        return wanted.join(near, "node_id", "left").select("node_id", "qualified_name", "name", F.coalesce("own_path", "module_path").alias("path"), "module_id", "hops")

    def execute(self, text: str, **params: object) -> tuple[Graph, DataFrame | None]:
        from canopy.plans.cypher import execute

        return execute(self, text, params)

    def cypher(self, text: str, **params: object) -> DataFrame:
        from canopy.plans.cypher import query

        return query(self, text, params)


def current_nodes(rows: DataFrame) -> DataFrame:
    """One row per living `node_id`: properties merged with the last value of each, by `created_at`.

    Deleted rows don't count. The label is that of the last row too. Rows with a null id are left out.
    """
    alive = rows.where("node_id is not null and deleted_at is null")
    head = alive.withColumn("label", F.try_element_at("labels", F.lit(1))).groupBy("node_id").agg(last_wins("label", "created_at").alias("label"), last_wins("project", "created_at").alias("project"))
    values = alive.select("node_id", "created_at", F.explode("properties").alias("key", "value")).groupBy("node_id", "key").agg(last_wins("value", "created_at").alias("value"))
    merged = values.where("value is not null").groupBy("node_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("properties"))
    return head.join(merged, "node_id", "left").select("node_id", F.when(F.col("label").isNotNull(), F.array("label")).otherwise(F.array().cast("array<string>")).alias("labels"), F.coalesce("properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("properties"), "project")


def stored_edges(rows: DataFrame) -> DataFrame:
    """One row per `rel_id`, with the properties of a delivery that has some; types are trimmed and in upper case, null ends are left out."""
    rows = rows.where("rel_id is not null and from_id is not null and to_id is not null").withColumn("type", edge_type())
    first = F.min(F.struct("from_id", "to_id", "type")).alias("e")
    edges = rows.groupBy("rel_id").agg(first, F.max(F.map_entries("properties")).alias("entries"))
    return edges.select("rel_id", "e.from_id", "e.to_id", "e.type", F.map_from_entries("entries").alias("properties"))


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], schema.NODES), spark.createDataFrame([], schema.EDGES))
