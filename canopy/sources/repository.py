"""Files of a repository, the structure of its directories, and exports of the graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from canopy.functions import paths
from canopy.graph import Graph
from canopy.session import cut
from canopy.sources.languages import BY_EXTENSION, PACKAGE_FILES


def scan(spark: SparkSession, root: str, project: str, exclude: tuple[str, ...] = (), unignore: tuple[str, ...] = ()) -> DataFrame:
    """(`project`, `path`, `content`, `size`) of the files below a root that aren't skipped.

    Spark's own file sources pass over empty files and names that begin with `_` or `.`, so the tree is listed here, and
    each task opens its files. The root is a folder or a URI that every executor can read.
    """
    files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    listed = [(f.path[len(base) + 1 :], f.size or 0) for f in files.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                content = []
                for path in part.column(0).to_pylist():
                    with store.open_input_stream(f"{base}/{path}") as f:
                        content.append(f.read())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary()), part.column(1)], ["path", "content", "size"])

    rows = spark.createDataFrame(listed, "path string, size bigint").where(~paths.should_skip(F.col("path"), True, exclude, unignore))
    # Neighbours in the listing are as large as they are; dealt out at random, tasks read about the same.
    found = rows.repartition(max(1, min(len(listed) // 64, 10_000)), F.xxhash64("path")).mapInArrow(read, "path string, content binary, size bigint")
    return found.select(F.lit(project).alias("project"), "path", "content", "size")


def language(path: Column) -> Column:
    """The language of a path by its extension; null if none is known."""
    table = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    return F.try_element_at(table, paths.suffix(path))


def directories(files: DataFrame) -> DataFrame:
    """(`project`, `directory`) of all directories of the files (`project`, `path`), the root as `.`."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    return files.select("project", F.explode(above).alias("directory")).distinct()


def structure(files: DataFrame) -> DataFrame:
    """(`project`, `label`, `key`, `name`, `path`, `parent_label`, `parent_key`, `type`): containers and files with their parents.

    A directory is a package if it holds a package file of any language, else a folder; the root is the project itself. A
    package's key is its dotted name, a folder's and a file's key its path. `type` is that of the edge from the parent.
    """
    files = files.select("project", "path").where("path is not null and project is not null").distinct()
    held = files.select("project", paths.parent(F.col("path")).alias("directory"), paths.name(F.col("path")).isin(PACKAGE_FILES).alias("marks"))
    marked = held.groupBy("project", "directory").agg(F.max("marks").alias("package"))
    dirs = directories(files).join(marked, ["project", "directory"], "left").withColumn("package", F.coalesce("package", F.lit(False)))
    kind = F.when(F.col("directory") == ".", "Project").when(F.col("package"), "Package").otherwise("Folder")
    key = F.when(F.col("directory") == ".", F.col("project")).when(F.col("package"), F.concat_ws(".", "project", F.translate("directory", "/", "."))).otherwise(F.col("directory"))
    dirs = dirs.select("project", "directory", kind.alias("label"), key.alias("key"))
    holders = dirs.select("project", F.col("directory").alias("up"), F.col("label").alias("parent_label"), F.col("key").alias("parent_key"))
    inner = dirs.where("directory <> '.'").withColumn("up", paths.parent(F.col("directory"))).join(holders, ["project", "up"])
    inner = inner.select("project", "label", "key", paths.name(F.col("directory")).alias("name"), F.col("directory").alias("path"), "parent_label", "parent_key", F.when(F.col("label") == "Package", "CONTAINS_PACKAGE").otherwise("CONTAINS_FOLDER").alias("type"))
    leaves = files.withColumn("up", paths.parent(F.col("path"))).join(holders, ["project", "up"])
    leaves = leaves.select("project", F.lit("File").alias("label"), F.col("path").alias("key"), paths.name(F.col("path")).alias("name"), "path", "parent_label", "parent_key", F.lit("CONTAINS_FILE").alias("type"))
    tops = dirs.where("directory = '.'").select("project", "label", "key", F.col("project").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("parent_label"), F.lit(None).cast("string").alias("parent_key"), F.lit(None).cast("string").alias("type"))
    return tops.unionByName(inner).unionByName(leaves)


def ignored_directories(files: DataFrame, depth: int) -> DataFrame:
    """(`group`, `paths`): ignored directories down to a depth, the outermost only, grouped by their name."""
    dirs = directories(files).where("directory <> '.'").select("directory").distinct()
    parts = F.split("directory", "/")
    name = F.element_at(parts, -1)
    inner = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(paths.IGNORED_PARTS))
    hits = dirs.where((F.size(parts) <= depth) & name.isin(paths.IGNORED_PARTS) & ~inner)
    return hits.groupBy(name.alias("group")).agg(F.sort_array(F.collect_list("directory")).alias("paths"))


def children(files: DataFrame, directory: str) -> DataFrame:
    """(`name`) of what a directory holds, sorted."""
    below = F.col("path") if directory in ("", ".") else F.when(F.col("path").startswith(directory + "/"), F.substr("path", F.lit(len(directory) + 2)))
    return files.select(F.split(below, "/")[0].alias("name")).where("name is not null").distinct().orderBy("name")


def load_graph(spark: SparkSession, path: str) -> Graph:
    """The graph of a JSON export `{nodes, relationships, metadata}`."""
    value = "map<string,string>"
    kind = f"nodes array<struct<node_id:bigint,labels:array<string>,properties:{value}>>, relationships array<struct<from_id:bigint,to_id:bigint,type:string,properties:{value}>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    nodes = rows.select(F.inline("nodes")).withColumn("project", F.lit(None).cast("string"))
    edges = rows.select(F.posexplode("relationships").alias("rel_id", "r")).select(F.col("rel_id").cast("bigint").alias("rel_id"), "r.*")
    return Graph(nodes, edges)


def load_tables(spark: SparkSession, path: str) -> Graph:
    """The graph that `save_tables` wrote in two tables."""
    nodes = spark.read.parquet(f"{path}/nodes").select("node_id", "labels", "properties", "project")
    edges = spark.read.parquet(f"{path}/relationships").select(F.xxhash64("from_id", "to_id", "type").alias("rel_id"), "from_id", "to_id", "type", "properties")
    return Graph(nodes, edges)


def save_graph(graph: Graph, path: str) -> None:
    """Writes nodes and relationships as JSON lines below `path`, and the counts beside them."""
    graph.nodes.select("node_id", "labels", "properties").write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.select("from_id", "to_id", "type", "properties").write.mode("overwrite").json(f"{path}/relationships")
    counts = graph.nodes.agg(F.count("*").alias("total_nodes")).join(F.broadcast(graph.edges.agg(F.count("*").alias("total_relationships"))))
    counts.withColumn("exported_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).write.mode("overwrite").json(f"{path}/metadata")


def export_document(graph: Graph) -> DataFrame:
    """The export as one JSON text, for graphs that fit in one row."""
    nodes = graph.nodes.select(F.struct("node_id", "labels", F.map_entries("properties").alias("p")).alias("n")).agg(F.sort_array(F.collect_list("n")).alias("n"))
    nodes = nodes.select(F.transform("n", lambda x: F.struct(x["node_id"].alias("node_id"), x["labels"].alias("labels"), F.map_from_entries(x["p"]).alias("properties"))).alias("nodes"))
    edges = graph.edges.select(F.struct("rel_id", "from_id", "to_id", "type", F.map_entries("properties").alias("p")).alias("e")).agg(F.sort_array(F.collect_list("e")).alias("e"))
    edges = edges.select(F.transform("e", lambda x: F.struct(x["from_id"].alias("from_id"), x["to_id"].alias("to_id"), x["type"].alias("type"), F.map_from_entries(x["p"]).alias("properties"))).alias("relationships"))
    both = nodes.join(F.broadcast(edges))
    metadata = F.struct(F.size("nodes").alias("total_nodes"), F.size("relationships").alias("total_relationships"))
    return both.select(F.to_json(F.struct("nodes", "relationships", metadata.alias("metadata"))).alias("document"))


def document_lines(graph: Graph) -> DataFrame:
    """(`section`, `key`, `line`): the export as the lines of one JSON document, in order, for graphs of any size.

    Each node (by `node_id`, section 1) and each relationship (by `rel_id`, section 3) is a line of its own, with the comma
    before it; the lines between hold brackets, the last one the counts. No row holds more than one node or relationship.
    """

    def listed(section: int, rows: DataFrame, key: str, *fields: str) -> tuple[DataFrame, int]:
        seen = Observation()
        lines = rows.select(F.lit(section).alias("section"), F.col(key).alias("key"), F.to_json(F.struct(*fields)).alias("line"))
        lines = cut(lines.observe(seen, F.count(F.lit(1)).alias("n"), F.min("key").alias("first")))
        line = F.when(F.col("key") == F.lit(seen.get["first"]), F.col("line")).otherwise(F.concat(F.lit(","), F.col("line")))
        return lines.withColumn("line", line), seen.get["n"]

    nodes, n = listed(1, graph.nodes, "node_id", "node_id", "labels", "properties")
    edges, m = listed(3, graph.edges, "rel_id", "from_id", "to_id", "type", "properties")
    rest = [(0, None, '{"nodes":['), (2, None, '],"relationships":['), (4, None, f'],"metadata":{{"total_nodes":{n},"total_relationships":{m}}}}}')]
    brackets = graph.nodes.sparkSession.createDataFrame(rest, "section int, key bigint, line string")
    return brackets.unionByName(nodes).unionByName(edges).orderBy("section", "key")


def save_tables(graph: Graph, path: str, split: bool = True) -> None:
    """The file sink: the first row of each node and one edge for each pair of ends and type, as Parquet.

    Split, nodes and edges are two tables, partitioned by label and type, so that label scans read only their own files.
    """
    nodes = graph.nodes.withColumn("label", F.try_element_at("labels", F.lit(1)))
    edges = graph.edges.where("from_id is not null and to_id is not null").groupBy("from_id", "to_id", "type").agg(F.max(F.map_entries("properties")).alias("properties"))
    edges = edges.withColumn("properties", F.map_from_entries("properties"))
    if split:
        nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
        edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/relationships")
        return
    blank = lambda t: F.lit(None).cast(t)
    rows = nodes.select(F.lit("node").alias("row"), "node_id", "labels", blank("bigint").alias("from_id"), blank("bigint").alias("to_id"), blank("string").alias("type"), "properties")
    rows = rows.unionByName(edges.select(F.lit("relationship").alias("row"), blank("bigint").alias("node_id"), blank("array<string>").alias("labels"), "from_id", "to_id", "type", "properties"))
    rows.write.mode("overwrite").parquet(f"{path}/graph")
