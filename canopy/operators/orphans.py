"""References to records that do not exist, direct and inherited.

Null ids are no references. A record without `created_at` never lives (and is not late either); one whose `deleted_at`
is not after its `created_at` never lives. Repeated records and references count once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.hierarchy import edge_type, hierarchy_edges
from canopy.session import cut, cut_counted, small


def lifetimes(records: DataFrame) -> DataFrame:
    """One row per `id`: the earliest `created_at` of it (null if one has none) and its disjoint `spans` of life.

    Overlapping and touching spans are joined in a running window, so repeated rows don't lengthen `spans`.
    """
    rows = records.where("id is not null").select("id", "created_at", "deleted_at").distinct()
    far = F.lit("9999-01-01").cast("timestamp")
    order = Window.partitionBy("id").orderBy("created_at", "until")
    rows = rows.withColumn("until", F.coalesce("deleted_at", far))
    rows = rows.withColumn("living", F.col("created_at").isNotNull() & (F.col("until") > F.col("created_at")))
    seen = F.max(F.when(F.col("living"), F.col("until"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(F.col("living") & (seen.isNull() | (seen < F.col("created_at"))), 1).otherwise(0))
    rows = rows.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy("id", "span").agg(
        F.min(F.when(F.col("living"), F.col("created_at"))).alias("start"), F.max(F.when(F.col("living"), F.col("until"))).alias("stop"), F.min("created_at").alias("first"), F.max(F.col("created_at").isNull()).alias("undated")
    )
    return spans.groupBy("id").agg(
        F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))).alias("spans"),
        F.when(F.max("undated"), F.lit(None)).otherwise(F.min("first")).alias("first"),
    )


def direct_orphans(references: DataFrame, records: DataFrame) -> DataFrame:
    """The `references` (`key` and `at`, with any other columns) that no row of `records` (`id`, `created_at`, `deleted_at`) answers.

    Adds `reason`: `missing` if no record has the id, `late` if all of them were created after `at`, else `deleted`.
    Rows with a null `at` are answered by no record; they are `deleted` if the id exists. Ids with very many references
    don't meet theirs in one task.
    """
    references = references.where("key is not null")
    hot = hot_keys(references)
    if hot is None:
        return _unanswered(references, lifetimes(records))
    # Few ids, so their lives are broadcast and their references stay where they are.
    ids = F.broadcast(hot)
    apart = lambda how: references.join(ids, "key", how).select(*references.columns)
    lives = lifetimes(records.join(ids.withColumnRenamed("key", "id"), "id", "left_semi"))
    return _unanswered(apart("left_anti"), lifetimes(records)).unionByName(_unanswered(apart("left_semi"), F.broadcast(lives)))


def hot_keys(references: DataFrame, share: int = 1000, least: int = 10_000) -> DataFrame | None:
    """(`key`) of those that more than one in `share` rows and more than `least` have, fewer than `share` in all; None if there are none."""
    bar = max(least, references.count() // share)
    hot, n = cut_counted(references.groupBy("key").count().where(f"count > {bar}").select("key"))
    return hot if n else None


def _unanswered(references: DataFrame, lives: DataFrame) -> DataFrame:
    joined = references.join(lives.withColumn("known", F.lit(True)), references["key"] == lives["id"], "left")
    alive = F.exists("spans", lambda s: (s["start"] <= F.col("at")) & (F.col("at") < s["stop"]))
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("first") > F.col("at"), "late").otherwise("deleted")
    return joined.where(F.col("known").isNull() | ~F.coalesce(alive, F.lit(False))).withColumn("reason", reason).select(*references.columns, "reason")


def edge_references(relationships: DataFrame) -> DataFrame:
    """Both endpoints of every edge as references: (`rel_id`, `endpoint`, `type`, `key`, `at`)."""
    return relationships.select(
        "rel_id",
        edge_type().alias("type"),
        F.col("seen_at").alias("at"),
        F.explode(F.array(*(F.struct(F.lit(e).alias("endpoint"), F.col(f"{e}_id").alias("key")) for e in ("from", "to")))).alias("end"),
    ).select("rel_id", "end.endpoint", "type", "end.key", "at")


def orphan_cascade(children: DataFrame, orphaned: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(`hierarchy`, `node_id`, `level`): records orphaned directly (level 0) or through their parents (level 1 and up).

    `children` has (`hierarchy`, `child`, `parent`); `orphaned` the directly orphaned (`hierarchy`, `node_id`). Each round
    semi-joins the links with the records found in the last one and leaves out those known already, until none is new;
    cycles end so too. `max_rounds` is for callers who want only the first levels; None goes to the end.
    """
    links = cut(children.where("child is not null and parent is not null").select("hierarchy", "child", "parent").distinct())
    known = cut(orphaned.select("hierarchy", "node_id").where("node_id is not null").distinct().withColumn("level", F.lit(0)))
    front, level = known, 0
    new = total = known.count()
    while new and (max_rounds is None or level < max_rounds):
        level += 1
        reached = links.join(small(front.select("hierarchy", F.col("node_id").alias("parent")), new), ["hierarchy", "parent"], "left_semi").select("hierarchy", F.col("child").alias("node_id")).distinct()
        front = cut(reached.join(small(known.select("hierarchy", "node_id"), total), ["hierarchy", "node_id"], "left_anti").withColumn("level", F.lit(level)))
        new = front.count()
        total += new
        known = known.unionByName(front)
        if level % 8 == 0:
            known = cut(known)
    return known


def cascade_over_graph(relationships: DataFrame, records: DataFrame) -> DataFrame:
    """`orphan_cascade` over the two hierarchies: direct are the children of edges whose parent's node is orphaned."""
    links = relationships.select("rel_id", "from_id", "to_id", "type", "seen_at")
    inherits = edge_type().isin("INHERITS", "IMPLEMENTS")
    refs = links.select("from_id", "to_id", "type", F.when(inherits, F.col("to_id")).otherwise(F.col("from_id")).alias("key"), F.col("seen_at").alias("at"))
    direct = hierarchy_edges(direct_orphans(refs, records)).select("hierarchy", F.col("child").alias("node_id"))
    return orphan_cascade(hierarchy_edges(links), direct)
