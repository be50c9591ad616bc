"""Files to graph: structure, definitions, imports, bases, overrides, calls and dependencies, as one plan of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy import schema
from canopy.graph import Graph, empty
from canopy.operators import mutate, resolve
from canopy.session import cut
from canopy.sources import extract, manifests, repository

_NODE = "label string, key string, property string, value string, seq bigint"


def _staged(rows: DataFrame, properties: dict[str, str]) -> DataFrame:
    """Rows (`label`, `key` and columns) as staging: one row for each property that isn't null."""
    pairs = F.array(*(F.struct(F.lit(name).alias("property"), F.col(c).cast("string").alias("value")) for name, c in properties.items()))
    return rows.select("label", "key", F.explode(pairs).alias("p"), F.lit(0).cast("bigint").alias("seq")).select("label", "key", "p.property", "p.value", "seq").where("value is not null")


def _edges(rows: DataFrame) -> DataFrame:
    """(`from_label`, `from_key`, `type`, `to_label`, `to_key`) as staging without properties."""
    return rows.withColumn("properties", F.create_map().cast("map<string,string>")).withColumn("seq", F.lit(0).cast("bigint"))


def index(files: DataFrame) -> Graph:
    """The graph of the files (`project`, `path`, `content`).

    Nodes come before edges, so an edge is stored if both its ends are defined, in whatever file. Repeated files of one
    path count once; rows without project, path or content give nothing.
    """
    files = cut(files.select("project", "path", F.col("content").cast("string").alias("content")).where("project is not null and path is not null").dropDuplicates(["project", "path"]))
    f = resolve.Facts(extract.facts(files))
    up = cut(resolve.parents(f))
    defined = f.definitions
    placed = cut(repository.structure(files))

    decorators = F.when(F.size("decorators") > 0, F.to_json("decorators"))
    own = defined.select("label", F.col("qualified_name").alias("key"), "qualified_name", "name", "path", "start_line", "end_line", "docstring", decorators.alias("decorators"), "is_exported")
    names = {c: c for c in ("qualified_name", "name", "path", "start_line", "end_line", "docstring", "decorators", "is_exported")}
    kind = placed.withColumn("qualified_name", F.when(F.col("label") == "Package", F.col("key"))).withColumn("path", F.when(F.col("label") != "Project", F.col("path")))
    kind = kind.withColumn("extension", F.when(F.col("label") == "File", F.regexp_extract("name", r"[^.](\.[^.]*)$", 1)))
    imports = resolve.import_targets(f)
    outside = imports.where("is_external").select(F.lit("Module").alias("label"), F.col("target").alias("key"), F.col("target").alias("qualified_name"), F.element_at(F.split("target", r"[./:]+"), -1).alias("name"), F.col("target").alias("path"), F.lit("true").alias("is_external")).distinct()
    packages, needs = manifests.dependency_graph(files)
    nodes = _staged(own, names).unionByName(_staged(kind, {c: c for c in ("qualified_name", "name", "path", "extension")})).unionByName(_staged(outside, {c: c for c in ("qualified_name", "name", "path", "is_external")})).unionByName(packages)

    labels = defined.select(F.col("qualified_name").alias("q"), F.col("label").alias("l"))
    end = lambda rows, c, e: rows.join(labels.withColumnsRenamed({"q": c, "l": f"{e}_label"}), c)
    named = lambda rows, a, b: rows.select("from_label", F.col(a).alias("from_key"), "type", "to_label", F.col(b).alias("to_key"))
    both = lambda rows: named(end(end(rows, "src", "from"), "dst", "to"), "src", "dst")
    module = lambda rows: rows.withColumns({"from_label": F.lit("Module"), "to_label": F.lit("Module")})
    holders = placed.where("label = 'File'").select("project", "path", F.col("parent_label").alias("from_label"), F.col("parent_key").alias("from_key"))
    modules = defined.where("label = 'Module'").select("project", "path", F.col("qualified_name").alias("to_key")).join(holders, ["project", "path"]).select("from_label", "from_key", F.lit("CONTAINS_MODULE").alias("type"), F.lit("Module").alias("to_label"), "to_key")
    calls = resolve.call_edges(resolve.resolve_calls(f, up)).select("src", "dst", F.lit("CALLS").alias("type"))
    overrides = resolve.overrides(f, up).select(F.col("method").alias("src"), F.col("overridden").alias("dst"), F.lit("OVERRIDES").alias("type"))
    edges = placed.where("type is not null").select(F.col("parent_label").alias("from_label"), F.col("parent_key").alias("from_key"), "type", F.col("label").alias("to_label"), F.col("key").alias("to_key"))
    edges = edges.unionByName(modules).unionByName(named(module(imports.select("module", "target", F.lit("IMPORTS").alias("type"))), "module", "target"))
    for more in (both(resolve.definition_edges(f)), both(up.select("src", "dst", "type")), both(overrides), both(calls)):
        edges = edges.unionByName(more)

    graph = mutate.merge_nodes(empty(files.sparkSession), nodes)
    graph = Graph(cut(graph.nodes.select(*schema.NODES.replace(",", "").split()[::2])), graph.edges)
    graph = mutate.merge_edges(graph, _edges(edges.distinct()).unionByName(needs))
    return Graph(graph.nodes, cut(graph.edges))
