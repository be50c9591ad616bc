"""Parent-child links to full hierarchies, by pointer doubling.

Input of every function is an edge table (`hierarchy`, `child`, `parent`); further columns are ignored, so clashing names
do no harm. Edges with a null end or a null hierarchy are left out, repeated edges count once, an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.session import cut, cut_counted, small

CONTAINMENT = ["CONTAINS_PACKAGE", "CONTAINS_FOLDER", "CONTAINS_FILE", "CONTAINS_MODULE", "DEFINES", "DEFINES_METHOD"]
INHERITANCE = ["INHERITS", "IMPLEMENTS"]
KEY = ["hierarchy", "child", "parent"]


def edge_type(column: str = "type") -> Column:
    """The type of an edge, without outer blanks and in upper case."""
    return F.upper(F.btrim(F.col(column), F.lit(" \t\r\n\f\v")))


def hierarchy_edges(relationships: DataFrame) -> DataFrame:
    """Distinct (`hierarchy`, `child`, `parent`) of the containment and the inheritance edges.

    Containment edges run from parent to child, inheritance edges from child to parent. Null ids and null or other types
    give no edge.
    """
    t, a, b = edge_type(), F.col("from_id"), F.col("to_id")
    inherits = t.isin(INHERITANCE)
    return (
        relationships.where(a.isNotNull() & b.isNotNull() & (t.isin(CONTAINMENT) | inherits))
        .select(
            F.when(inherits, "inheritance").otherwise("containment").alias("hierarchy"),
            F.when(inherits, a).otherwise(b).alias("child"),
            F.when(inherits, b).otherwise(a).alias("parent"),
        )
        .distinct()
    )


def _restrict(links: DataFrame, alive: DataFrame, rows: int) -> DataFrame:
    """The links of which both ends are alive; `rows` counts these."""
    ends = lambda c: small(alive.select("hierarchy", F.col("id").alias(c)), rows)
    return links.join(ends("child"), ["hierarchy", "child"], "left_semi").join(ends("parent"), ["hierarchy", "parent"], "left_semi").select(*KEY)


def _compose(first: DataFrame, second: DataFrame, rows: int) -> DataFrame:
    """Walks made of a link of `first` and then one of `second`; `rows` counts the second."""
    up = second.select("hierarchy", F.col("child").alias("parent"), F.col("parent").alias("beyond"))
    return first.join(small(up, rows), ["hierarchy", "parent"]).select("hierarchy", "child", F.col("beyond").alias("parent"))


def _inner(links: DataFrame) -> DataFrame:
    """(`hierarchy`, `id`) of the nodes that have links upwards and downwards."""
    end = lambda c, up: F.struct(F.col(c).alias("id"), F.lit(up).alias("up"))
    ends = links.select("hierarchy", F.explode(F.array(end("child", True), end("parent", False))).alias("end")).select("hierarchy", "end.id", "end.up")
    return ends.groupBy("hierarchy", "id").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down")).where("up and down").select("hierarchy", "id")


def cyclic_core(edges: DataFrame, growth: int = 4, enough: int = 0) -> DataFrame:
    """The edges all of whose ends have endless walks upwards and downwards: those on cycles, or between two.

    In round k the pointers of a node lead to its ancestors 2^k links away. A node without pointers, or to which none
    lead, has no walk of that length and is on no cycle, so it goes; after logarithmically many rounds only the core is
    left. Where a node has several parents, pointers can multiply; above `growth` times the first edges the rounds go on
    with the single links, which takes more of them and gives the same core. With no more than `enough` edges left, the
    rounds end as soon as one takes away less than half of them; some edges outside the core then come out too.
    """
    edges, size = cut_counted(edges)
    pointers, limit, single, doubling = edges, growth * size + 1_000_000, True, True
    while size:
        alive, n = cut_counted(_inner(pointers))
        kept, left = cut_counted(_restrict(edges, alive, n))
        if left == size:
            if single:
                return kept
            pointers, single = kept, True
            continue
        slow = 2 * left > size and left <= enough
        edges, size = kept, left
        if slow:
            break
        if doubling and left:
            # Of the single links only the core's are left; longer pointers between its nodes are squared.
            inner = edges if single else _restrict(pointers, alive, n)
            squared, reached = cut_counted(_compose(inner, inner, left).distinct())
            doubling = reached <= limit
            pointers, single = (squared, False) if doubling else (edges, True)
        else:
            pointers, single = edges, True
    return edges


def _lowest(edges: DataFrame, start: DataFrame, source: str, target: str) -> DataFrame:
    """(`hierarchy`, `id`, `low`): the smallest start label that reaches each node from `source` to `target`."""
    labels = cut(start)
    while True:
        moved = edges.join(labels.select("hierarchy", F.col("id").alias(source), "low"), ["hierarchy", source]).select("hierarchy", F.col(target).alias("id"), "low")
        merged = cut(labels.withColumnRenamed("low", "old").join(moved.groupBy("hierarchy", "id").agg(F.min("low").alias("new")), ["hierarchy", "id"], "left").select("hierarchy", "id", "old", F.least("old", F.coalesce("new", "old")).alias("low")))
        changed = merged.where("low < old").limit(1).count()
        labels = merged.select("hierarchy", "id", "low")
        if not changed:
            return labels


def _components_by_colour(core: DataFrame) -> DataFrame:
    """Strongly connected components in linear space: smallest ancestor as colour, then what that ancestor reaches back."""
    found, edges = None, core
    while edges.limit(1).count():
        nodes = edges.select("hierarchy", F.explode(F.array("child", "parent")).alias("id")).distinct()
        colour = _lowest(edges, nodes.withColumn("low", F.col("id")), "parent", "child").withColumnRenamed("low", "colour")
        of = lambda c: colour.select("hierarchy", F.col("id").alias(c), F.col("colour").alias(f"{c}_colour"))
        inside = cut(edges.join(of("child"), ["hierarchy", "child"]).join(of("parent"), ["hierarchy", "parent"]).where("child_colour = parent_colour").select(*KEY))
        back = _lowest(inside, nodes.withColumn("low", F.col("id")), "child", "parent")
        done = cut(colour.join(back, ["hierarchy", "id"]).where("low = colour").select("hierarchy", "id", F.col("colour").alias("cycle_id")))
        found = done if found is None else found.unionByName(done)
        gone = lambda c: done.select("hierarchy", F.col("id").alias(c))  # noqa: E731, B023
        edges = cyclic_core(edges.join(gone("child"), ["hierarchy", "child"], "left_anti").join(gone("parent"), ["hierarchy", "parent"], "left_anti").select(*KEY))
    if found is None:
        return core.select("hierarchy", F.col("child").alias("id"), F.col("child").alias("cycle_id")).limit(0)
    many = found.groupBy("hierarchy", "cycle_id").count().where("count > 1").drop("count")
    return found.join(many, ["hierarchy", "cycle_id"], "left_semi").select("hierarchy", "id", "cycle_id")


def _components(core: DataFrame, growth: int) -> DataFrame:
    """(`hierarchy`, `id`, `cycle_id`) of the strongly connected components of more than one node.

    Reach doubles in each round; two nodes that reach each other share a component. Where the pairs would outgrow
    `growth` times the core's edges, colours find the same components in linear space.
    """
    reach, size = cut_counted(core)
    limit = growth * size + 4_000_000
    while size:
        wider, now = cut_counted(reach.unionByName(_compose(reach, reach, size)).distinct())
        if now == size:
            break
        if now > limit:
            return _components_by_colour(core)
        reach, size = wider, now
    back = reach.select("hierarchy", F.col("parent").alias("child"), F.col("child").alias("parent"))
    return reach.join(back, KEY).groupBy("hierarchy", F.col("child").alias("id")).agg(F.min(F.least("child", "parent")).alias("cycle_id"))


def find_cycles(edges: DataFrame, growth: int = 64) -> DataFrame:
    """(`hierarchy`, `cycle_id`, `node_id`) of every node on a cycle, an edge to itself included.

    `cycle_id` is the smallest id among the nodes that the node reaches and is reached from, itself included.
    """
    edges = cut(edges.select(*KEY).where("hierarchy is not null and child is not null and parent is not null").distinct())
    loops = edges.where("child = parent").select("hierarchy", F.col("child").alias("node_id"))
    found = _components(cyclic_core(edges.where("child <> parent"), enough=20_000), growth).withColumnRenamed("id", "node_id")
    return found.join(loops, ["hierarchy", "node_id"], "full").select("hierarchy", F.coalesce("cycle_id", "node_id").alias("cycle_id"), "node_id")


def resolve_paths(edges: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """(`hierarchy`, `node_id`, `root_id`, `depth`, `ancestors`, `in_cycle`) of every node: one path from it to a root.

    `ancestors` runs from the parent to the root. A node with several parents follows the smallest one; every ancestor
    over every parent comes from `all_descendants`. The nodes of a cycle count as one, which stands in paths as the
    cycle's smallest id, has the parents of all its members outside the cycle, and may have nodes above and below it; a
    member has the cycle's path, with `in_cycle` true. A node without parents is its own root, a cycle without parents
    outside has its smallest id. In each round a pointer jumps to where the node it leads to points, and the two path
    segments are joined; depth d takes about log2(d) rounds, and only paths that are not yet at their root move on.
    """
    edges = cut(edges.select(*KEY).where("hierarchy is not null and child is not null and parent is not null").distinct())
    cycles = cut((find_cycles(edges) if cycles is None else cycles).select("hierarchy", "node_id", "cycle_id").distinct())
    n = cycles.count()
    of = lambda c: small(cycles.select("hierarchy", F.col("node_id").alias(c), F.col("cycle_id").alias(f"{c}_cycle")), n)
    links = edges.join(of("child"), ["hierarchy", "child"], "left").join(of("parent"), ["hierarchy", "parent"], "left")
    links = links.select("hierarchy", F.coalesce("child_cycle", "child").alias("node_id"), F.coalesce("parent_cycle", "parent").alias("next"))
    # Loops inside a cycle keep their node, without a parent.
    ends = links.select("hierarchy", F.explode(F.array(F.struct("node_id", F.when(F.col("next") != F.col("node_id"), F.col("next")).alias("next")), F.struct(F.col("next").alias("node_id"), F.lit(None).cast("bigint").alias("next")))).alias("e"))
    first = ends.groupBy("hierarchy", "e.node_id").agg(F.min("e.next").alias("next"))
    at = cut(first.withColumn("ancestors", F.when(F.col("next").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("next"))))
    done = [at.where("next is null")]
    while at.where("next is not null").limit(1).count():
        # Whoever points to a finished node is finished by it, so the finished ones of all rounds stay to be met.
        known = at.where("next is not null")
        for d in done:
            known = known.unionByName(d)
        there = known.select("hierarchy", F.col("node_id").alias("next"), F.col("next").alias("beyond"), F.col("ancestors").alias("segment"))
        at = cut(at.where("next is not null").join(there, ["hierarchy", "next"]).select("hierarchy", "node_id", F.col("beyond").alias("next"), F.concat("ancestors", "segment").alias("ancestors")))
        done.append(at.where("next is null"))
    paths = done[0]
    for d in done[1:]:
        paths = paths.unionByName(d)
    paths = paths.select("hierarchy", "node_id", F.coalesce(F.try_element_at("ancestors", F.lit(-1)), "node_id").alias("root_id"), F.size("ancestors").alias("depth"), "ancestors")
    member = small(cycles.select("hierarchy", F.col("cycle_id").alias("node_id"), F.col("node_id").alias("member")), n)
    return paths.join(member, ["hierarchy", "node_id"], "left").select("hierarchy", F.coalesce("member", "node_id").alias("node_id"), "root_id", "depth", "ancestors", F.col("member").isNotNull().alias("in_cycle"))


def hierarchy_report(paths: DataFrame, below: DataFrame) -> DataFrame:
    """`resolve_paths` with `path` as text from the root to the node, and the number of all its descendants (`all_descendants`)."""
    counts = below.groupBy("hierarchy", F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n_descendants"))
    path = F.array_join(F.concat(F.reverse("ancestors"), F.array("node_id")).cast("array<string>"), "/")
    return paths.join(counts, ["hierarchy", "node_id"], "left").select("hierarchy", "node_id", "root_id", "depth", path.alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), "in_cycle")


def all_descendants(edges: DataFrame) -> DataFrame:
    """(`hierarchy`, `ancestor_id`, `node_id`, `distance`) of every node below each node over all edges, through every parent.

    `distance` is the length of the shortest walk. Members of a cycle are below each other, and what is above or below one
    of them is so for all; no node is below itself. After k rounds all pairs up to 2^k links apart are known; a farther one
    up to 2^(k+1) passes a node exactly 2^k above, so only pairs of that distance are joined, and there are as many rounds
    as the longest distance has binary digits. Each round writes only its new pairs.
    """
    edges = edges.select(*KEY).where("hierarchy is not null and child is not null and parent is not null and child <> parent").distinct()
    known = latest = cut(edges.withColumn("distance", F.lit(1)))
    far = 1
    while True:
        step = latest.where(F.col("distance") == far).select("hierarchy", "child", F.col("parent").alias("middle"))
        up = known.select("hierarchy", F.col("child").alias("middle"), "parent", (F.col("distance") + far).alias("distance"))
        longer = step.join(up, ["hierarchy", "middle"]).where("child <> parent").select(*KEY, "distance")
        # Known pairs carry a mark, so that one grouping both finds the shortest walk and drops what was known.
        new = longer.unionByName(known.select(*KEY, F.lit(0).alias("distance"))).groupBy(*KEY).agg(F.min("distance").alias("distance")).where("distance > 0")
        latest = cut(new)
        if not latest.limit(1).count():
            return known.select("hierarchy", F.col("parent").alias("ancestor_id"), F.col("child").alias("node_id"), "distance")
        known, far = known.unionByName(latest), 2 * far


def all_roots(edges: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """(`hierarchy`, `node_id`, `root_id`) of every root above each node; a root has itself.

    A root has no ancestors but those that are also below it; of a cycle with nothing above it the smallest id stands.
    """
    edges = edges.select(*KEY).where("hierarchy is not null and child is not null and parent is not null").distinct()
    below = all_descendants(edges) if below is None else below
    nodes = edges.select("hierarchy", F.explode(F.array("child", "parent")).alias("node_id")).distinct()
    back = below.select("hierarchy", F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("node_id"), F.lit(True).alias("mutual"))
    above = below.join(back, ["hierarchy", "ancestor_id", "node_id"], "left").groupBy("hierarchy", "node_id").agg(F.bool_or(F.col("mutual").isNull() | (F.col("ancestor_id") < F.col("node_id"))).alias("lower")).where("lower")
    roots = cut(nodes.join(above, ["hierarchy", "node_id"], "left_anti").select("hierarchy", F.col("node_id").alias("root_id")))
    under = below.join(roots.withColumnRenamed("root_id", "ancestor_id"), ["hierarchy", "ancestor_id"], "left_semi").select("hierarchy", "node_id", F.col("ancestor_id").alias("root_id"))
    return under.unionByName(roots.select("hierarchy", F.col("root_id").alias("node_id"), "root_id"))
