"""python -m canopy index ROOT OUT [--project NAME] | stats GRAPH | export GRAPH OUT | query GRAPH CYPHER

A graph is a folder written by `index`, or a JSON export.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from canopy.functions.text import shown
from canopy.graph import Graph
from canopy.plans.index import index
from canopy.sources import repository


def open_graph(spark: SparkSession, where: str) -> Graph:
    """The graph of a JSON export (a file) or of a folder of tables."""
    return repository.load_graph(spark, where) if where.endswith(".json") else repository.load_tables(spark, where)


def show(rows: DataFrame, most: int = 500) -> None:
    """Prints the first rows as a table, empty for null."""
    shown(rows).show(most, truncate=False)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="canopy", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, *operands in (("index", "root", "out"), ("stats", "graph"), ("export", "graph", "out"), ("query", "graph", "cypher")):
        command = commands.add_parser(name)
        for o in operands:
            command.add_argument(o)
        if name == "index":
            command.add_argument("--project")
            command.add_argument("--exclude", action="append", default=[])
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("canopy").getOrCreate()
    if a.command == "index":
        project = a.project or os.path.basename(os.path.abspath(a.root))
        repository.save_tables(index(repository.scan(spark, os.path.abspath(a.root), project, tuple(a.exclude))), a.out)
    elif a.command == "stats":
        show(open_graph(spark, a.graph).summary().orderBy("kind", "name"))
    elif a.command == "export":
        repository.save_graph(open_graph(spark, a.graph), a.out)
    else:
        show(open_graph(spark, a.graph).cypher(a.cypher))
    return 0


if __name__ == "__main__":
    sys.exit(main())
