"""The vector store: upsert, delete, verify and search of (`node_id`, `qualified_name`, `embedding`)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.text import slice_lines
from canopy.functions.vector import top_k
from canopy.graph import Graph


def upsert(store: DataFrame, points: DataFrame, key: str = "node_id") -> DataFrame:
    """The store with the points; a point replaces the one with its key. Points must have distinct keys."""
    return store.join(points.select(key), key, "left_anti").unionByName(points)


def delete(store: DataFrame, ids: DataFrame, key: str = "node_id") -> DataFrame:
    return store.join(ids.select(key), key, "left_anti")


def missing(expected: DataFrame, store: DataFrame, key: str = "node_id") -> DataFrame:
    return expected.join(store.select(key), key, "left_anti")


def search(graph: Graph, store: DataFrame, wanted: list[float], k: int = 5, key: str = "node_id") -> DataFrame:
    """(`node_id`, `qualified_name`, `name`, `type`, `score`) of the `k` best points, ids without a node left out."""
    best = top_k(store, key, "embedding", wanted, k).withColumnRenamed(key, "node_id")
    rows = graph.nodes.join(F.broadcast(best), "node_id")
    prop = lambda n: F.try_element_at("properties", F.lit(n)).alias(n)
    return rows.select("node_id", prop("qualified_name"), prop("name"), F.try_element_at("labels", F.lit(1)).alias("type"), F.bround("score", 3).alias("score")).orderBy(F.desc("score"), "node_id")


def candidates(graph: Graph, include_methods: bool = False) -> DataFrame:
    """Functions to embed with the path of the module that defines them. Methods hang off classes and come only on demand."""
    text = "MATCH (m:Module)-[:DEFINES]->(n) WHERE (n:Function OR n:Method) RETURN id(n) AS node_id, n.qualified_name AS qualified_name, n.start_line AS start_line, n.end_line AS end_line, m.path AS path"
    rows = graph.cypher(text)
    if include_methods:
        rows = rows.unionByName(graph.cypher(text.replace("-[:DEFINES]->(n)", "-[:DEFINES]->(c)-[:DEFINES_METHOD]->(n)")))
    return rows.orderBy(F.asc_nulls_last("qualified_name"))


def sources(rows: DataFrame, files: DataFrame) -> DataFrame:
    """`candidates` with their source text from `files` (`path`, `content`)."""
    return rows.join(files, "path").withColumn("source", slice_lines(F.col("content"), F.col("start_line").cast("int"), F.col("end_line").cast("int"))).drop("content")


def embed(source: Column, model: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Column:
    """Vectors of a text column by a model over batches of texts; the model is given by the caller."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for at in range(0, len(texts), batch):
            out += model(list(texts.iloc[at : at + batch]))
        return pd.Series(out)

    return run(source)
