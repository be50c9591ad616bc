"""Expressions on dotted names. Null names give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.session import cut


def last_part(name: Column) -> Column:
    """What stands behind the last `.` or `:`."""
    return F.element_at(F.split(name, "[.:]"), -1)


def owner(name: Column) -> Column:
    """What stands before the last dot."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.when(name.isNotNull(), ""))


def separator(name: Column) -> Column:
    """`::` before `:` before `.`."""
    return F.when(name.contains("::"), "::").when(name.contains(":"), ":").when(name.isNotNull(), ".")


def has_prefix(name: Column, prefix: Column | str) -> Column:
    """Whether a dotted prefix leads to the name: the name itself or below it; all names have the empty prefix."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (prefix == "") | (name == prefix) | name.startswith(F.concat(prefix, F.lit(".")))


def has_suffix(name: Column, suffix: Column | str) -> Column:
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    return name.endswith(F.concat(F.lit("."), suffix))


def common_parts(a: Column, b: Column) -> Column:
    """How many leading parts two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.least(F.size(a), F.size(b))).otherwise(at - 1).cast("int")


def import_distance(candidate: Column, caller: Column) -> Column:
    """The longer name's parts less the common ones; one less if the candidate is below the caller's parent.

    A caller of one part has the parent "", below which is what begins with a dot.
    """
    c, m = F.split(candidate, r"\."), F.split(caller, r"\.")
    near = candidate.startswith(F.concat(owner(caller), F.lit(".")))
    return F.greatest(F.size(c), F.size(m)) - common_parts(c, m) - near.cast("int")


def module_distance(candidate: Column, caller: Column) -> Column:
    """As `import_distance`, but never below 0."""
    return F.greatest(import_distance(candidate, caller), F.lit(0))


def camel(name: Column) -> Column:
    """`snake_case` as `SnakeCase`; letters behind the first of a part become small."""
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000)))), "")


def match_score(parameter: Column, cls: Column) -> Column:
    """How well a class's name fits a parameter's: 100 if equal, 90 if one ends with the other, else 80 by share of length."""
    p, c = F.lower(parameter), F.lower(cls)
    share = F.floor(F.lit(80) * (F.length(c) / F.nullif(F.length(p), F.lit(0))))
    return F.when(p == c, 100).when(c.endswith(p) | p.endswith(c), 90).when(p.contains(c), share).otherwise(F.when(p.isNotNull() & c.isNotNull(), 0)).cast("int")


def scored_pairs(parameters: DataFrame, classes: DataFrame) -> DataFrame:
    """(`param`, `class`, `score`) of all pairs of a parameter's and a class's name that score by `match_score`.

    A pair scores if one name ends with the other or the parameter's holds the class's, so all parts of parameters' names
    are looked up among the classes, and parameters among the ends of classes' names; no pair is formed to be dropped.
    """
    p = parameters.select("param").where("param <> ''").distinct().withColumn("p", F.lower("param"))
    c = classes.select("class").where("class <> ''").distinct().withColumn("c", F.lower("class"))
    starts = F.sequence(F.lit(1), F.length("p"))
    parts = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length("p") - i + 1), lambda n: F.substr(F.col("p"), i, n)))))
    ends = F.transform(F.sequence(F.lit(1), F.length("c")), lambda i: F.substr(F.col("c"), i))
    inside = p.select("param", F.explode(parts).alias("c")).join(c, "c").select("param", "class")
    around = c.select("class", F.explode(ends).alias("p")).join(p, "p").select("param", "class")
    pairs = inside.unionByName(around).distinct()
    return pairs.withColumn("score", match_score(F.col("param"), F.col("class"))).where("score > 0")


def best_class(scored: DataFrame) -> DataFrame:
    """(`param`, `class`, `score`): the class with the greatest score for each parameter, the first name of several."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("class")))
    return scored.groupBy("param").agg(best.alias("b")).select("param", "b.class", (-F.col("b.s")).alias("score"))


def suffix_matches(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """(`suffix`, `qualified_name`): definitions (`name`, `qualified_name`) with the simple name, or where nobody has it, the dotted end."""
    definitions = definitions.select("name", "qualified_name").where("qualified_name is not null").distinct()
    wanted = wanted.select("suffix").where("suffix is not null").distinct()
    named = wanted.join(definitions, F.col("suffix") == F.col("name")).select("suffix", "qualified_name")
    rest = wanted.join(definitions.select(F.col("name").alias("suffix")).distinct(), "suffix", "left_anti")
    parts = F.split("qualified_name", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    below = definitions.where(F.instr("qualified_name", ".") > 0).select("qualified_name", F.explode(ends).alias("suffix"))
    return named.unionByName(below.join(rest, "suffix").select("suffix", "qualified_name")).distinct()


def prefix_keys(parts: Column) -> Column:
    """A 64-bit key of each prefix of an array of parts, the empty one first."""
    return F.aggregate(parts, F.array(F.lit(0).cast("bigint")), lambda keys, p: F.array_append(keys, F.xxhash64(F.element_at(keys, -1), p)))


def nearest(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """(`caller`, `name`, `candidate`, `distance`): per wanted (`caller`, `name`) the nearest of the definitions (`name`, `qualified_name`).

    Nearest is the least `import_distance`, then the first name. Definitions are brought together by the prefixes of their
    names: below a prefix that it shares with a caller, only a definition's number of parts matters, so the first of each
    number is kept, and the distance follows from depths alone. A name that very many define and call doesn't make pairs of
    all of them. Names travel as their place in the sorted order.
    """
    parts = F.split("qualified_name", r"\.")
    wanted = wanted.select("caller", "name").where("name is not null and caller is not null").distinct()
    defined = definitions.select("name", "qualified_name").where("name is not null and qualified_name is not null").distinct()
    # Names that nobody defines, the most by far, have no answer; names that nobody wants give none.
    asked = cut(wanted.join(defined.select("name").distinct(), "name", "left_semi").withColumn("ask", F.monotonically_increasing_id()))
    # Ids of a sorted table are in its order, whatever the number of partitions.
    defined = defined.join(asked.select("name").distinct(), "name", "left_semi")
    defined = cut(defined.orderBy("qualified_name").withColumn("rank", F.monotonically_increasing_id()))
    below = defined.select("name", "rank", F.size(parts).alias("n"), F.explode(prefix_keys(parts)).alias("key"))
    below = below.groupBy("name", "key", "n").agg(F.min("rank").alias("rank"))
    caller = F.split("caller", r"\.")
    above = asked.select("ask", "name", F.size(caller).alias("m"), F.posexplode(prefix_keys(caller)).alias("k", "key"))
    near = (F.col("k") >= F.col("m") - 1) & (F.col("n") >= F.col("m")) & (F.col("m") > 1)
    distance = F.greatest("n", "m") - F.col("k") - near.cast("int")
    # Distance above rank in one number: the least is the nearest, then the first.
    packed = F.shiftleft((distance + 1).cast("bigint"), 48) + F.col("rank")
    best = above.join(below, ["name", "key"]).groupBy("ask").agg(F.min(packed).alias("best"))
    best = best.select("ask", (F.shiftright("best", 48) - 1).cast("int").alias("distance"), F.col("best").bitwiseAND(F.lit((1 << 48) - 1)).alias("rank"))
    named = defined.select("rank", F.col("qualified_name").alias("candidate"))
    return asked.join(best, "ask").join(named, "rank").select("caller", "name", "candidate", "distance")
