"""Bounded and unbounded walks over edges (`src`, `dst`), as loops over frontiers.

Null ends are left out and repeated edges count once; cycles end, since a node is entered only once per start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import cut, cut_counted, small


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def reachable(starts: DataFrame, edges: DataFrame, min_hops: int = 1, max_hops: int | None = None) -> DataFrame:
    """(`start`, `id`, `hops`): what each start (column `start`) reaches, with the fewest hops; `min_hops` is 0 or 1.

    A start reaches itself with 0 hops, or if `min_hops` is 1, over a cycle. Each round joins only the nodes that are new
    with the edges and leaves out the pairs known already.
    """
    steps = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    front = cut(starts.select("start", F.col("start").alias("id")).where("start is not null").distinct().withColumn("hops", F.lit(0)))
    seen = front if min_hops == 0 else front.limit(0)
    new = front.count()
    known, hops = new * (min_hops == 0), 0
    while new and (max_hops is None or hops < max_hops):
        hops += 1
        moved = small(front, new).join(steps, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        front = cut(moved.join(small(seen.select("start", "id"), known), ["start", "id"], "left_anti").withColumn("hops", F.lit(hops)))
        new = front.count()
        known += new
        seen = seen.unionByName(front)
        if hops % 8 == 0:
            seen = cut(seen)
    return seen


def reach_set(starts: DataFrame, edges: DataFrame, min_hops: int = 0) -> DataFrame:
    """Distinct `id` reached from any of the starts (column `id`)."""
    steps = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    front = cut(starts.select("id").where("id is not null").distinct())
    seen = front if min_hops == 0 else front.limit(0)
    new = front.count()
    known, rounds = new * (min_hops == 0), 0
    while new:
        rounds += 1
        moved = steps.join(small(front, new), F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        front = cut(moved.join(small(seen, known), "id", "left_anti"))
        new = front.count()
        known += new
        seen = seen.unionByName(front)
        if rounds % 8 == 0:
            seen = cut(seen)
    return seen


def nearest_hits(starts: DataFrame, edges: DataFrame, hits: DataFrame, own: bool = False) -> DataFrame:
    """(`start`, `name`, `id`, `hops`): per start and wanted `name`, the first ancestor in breadth-first order that has it.

    `starts` has (`start`, `name`), `edges` (`src`, `dst`, `ord`) with the order of parents, `hits` (`id`, `name`). Nodes
    of one level stand in the order of their parents' places (`route`); a node counts where it is met first. With `own`,
    the start itself may answer.
    """
    steps = cut(edges.select("src", "dst", "ord").where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("ord").alias("ord")))
    wanted = cut(starts.select("start", "name").distinct())
    front = cut(wanted.select("start").distinct().select("start", F.col("start").alias("id"), F.array().cast("array<int>").alias("route")))
    seen, found, hops = front.select("start", "id"), None, 0
    new = known = front.count()
    hits = cut(hits.select("id", "name").distinct())
    first = Window.partitionBy("start", "id").orderBy("route")
    best = Window.partitionBy("start", "name").orderBy("route", "id")
    while new:
        left = wanted.count()
        if not left:
            break
        if hops or own:
            met = small(front, new).join(hits, "id").join(small(wanted, left), ["start", "name"], "left_semi").withColumn("n", F.row_number().over(best)).where("n = 1")
            met = cut(met.select("start", "name", "id", F.lit(hops).alias("hops")))
            found = met if found is None else found.unionByName(met)
            wanted = cut(wanted.join(small(met.select("start", "name"), met.count()), ["start", "name"], "left_anti"))
        hops += 1
        open_ = front.join(wanted.select("start").distinct(), "start", "left_semi")
        moved = open_.join(steps, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"), F.concat("route", F.array(F.col("ord").cast("int"))).alias("route"))
        moved = moved.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        front = cut(moved.join(small(seen, known), ["start", "id"], "left_anti"))
        new = front.count()
        known += new
        seen = seen.unionByName(front.select("start", "id"))
        if hops % 8 == 0:
            seen = cut(seen)
    if found is None:
        return wanted.select("start", "name", F.col("start").alias("id"), F.lit(0).alias("hops")).limit(0)
    return found


def nearest_sources(sources: DataFrame, steps: DataFrame) -> DataFrame:
    """(`id`, `source`, `hops`): for each node that can be reached over (`src`, `dst`) the nearest of the sources (column `id`).

    Of several at one distance the smallest counts; a source is its own with 0 hops. All sources walk at once, and each
    node hands on only the one it took, so a node with very many neighbours costs its edges and no more.
    """
    steps = cut(steps.select("src", "dst").where("src is not null and dst is not null").distinct())
    front, new = cut_counted(sources.select("id").where("id is not null").distinct().select("id", F.col("id").alias("source"), F.lit(0).alias("hops")))
    seen, hops, known = front, 0, new
    while new:
        hops += 1
        moved = small(front, new).join(steps, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("source").alias("source"))
        front, new = cut_counted(moved.select(F.col("dst").alias("id"), "source", F.lit(hops).alias("hops")).join(small(seen.select("id"), known), "id", "left_anti"))
        seen, known = seen.unionByName(front), known + new
        if hops % 8 == 0:
            seen = cut(seen)
    return seen
