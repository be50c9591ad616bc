"""Resolution of imports, base classes, overrides and calls by joins on the facts of all files.

Each step collects candidates of several tiers and keeps the best by tier, then order, then name, in one aggregation. The
facts of all files are there before anything is resolved, so no result depends on the order of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.names import last_part, module_distance, nearest
from canopy.operators.traverse import nearest_hits
from canopy.session import cut


class Facts:
    """The tables of one extraction (`sources.extract.facts`)."""

    def __init__(self, facts: DataFrame) -> None:
        facts = cut(facts)
        of = lambda kind: facts.where(F.col("fact") == kind)
        self.definitions = of("definition").groupBy("qualified_name").agg(F.min_by(F.struct("project", "path", "module", "name", "label", "parent", "parent_label", "start_line", "end_line", "docstring", "decorators", "is_exported"), F.struct("path", "start_line")).alias("d")).select("qualified_name", "d.*")
        self.imports = local_imports(of("import").groupBy("module", "name").agg(F.max_by("target", "ord").alias("target"), F.min("ord").alias("ord")), of("definition").where("label = 'Module'").select("module"))
        self.inherits = of("inherits").select("module", F.col("qualified_name").alias("class"), "name", "ord").distinct()
        self.variables = of("variable").groupBy("module", F.col("parent").alias("scope"), "name").agg(F.max_by("target", "start_line").alias("target"))
        self.calls = of("call").select("module", F.col("parent").alias("caller"), "name", F.col("target").alias("class"), F.col("start_line").alias("line"))


def local_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports with `target` under the project's name if the project has that top-level name."""
    tops = modules.select(F.split("module", r"\.")[0].alias("project"), F.split("module", r"\.")[1].alias("top")).where("top is not null").distinct()
    rows = imports.withColumns({"project": F.split("module", r"\.")[0], "top": F.split("target", r"\.")[0]})
    own = rows.join(tops.withColumn("own", F.lit(True)), ["project", "top"], "left")
    target = F.when(F.col("own") & (F.col("top") != F.col("project")), F.concat_ws(".", "project", "target")).otherwise(F.col("target"))
    name = F.when(F.col("name").startswith("*"), F.concat(F.lit("*"), target)).otherwise(F.col("name"))
    return own.select("module", name.alias("name"), target.alias("target"), "ord")


def _best(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the candidate with the least (`tier`, `ord`, `target`)."""
    return candidates.groupBy(*keys).agg(F.min(F.struct("tier", "ord", "target")).alias("b")).select(*keys, "b.tier", "b.target")


def import_targets(f: Facts) -> DataFrame:
    """(`module`, `target`, `is_external`): the module that each import leads to.

    An imported definition leads to its module, an imported module to itself; of anything else the last part is left out,
    and the module is external.
    """
    defs = f.definitions.select(F.col("qualified_name").alias("q"), F.when(F.col("label") == "Module", F.col("qualified_name")).otherwise(F.col("module")).alias("m"))
    short = F.when(F.instr("target", ".") > 0, F.regexp_replace("target", r"\.[^.]*$", "")).otherwise(F.col("target"))
    full = f.imports.select("module", "target", short.alias("short"), F.col("name").startswith("*").alias("wild"))
    found = full.join(defs, F.col("target") == F.col("q"), "left").drop("q").withColumnRenamed("m", "direct")
    modules = f.definitions.where("label = 'Module'").select(F.col("qualified_name").alias("q"))
    found = found.join(modules, F.col("short") == F.col("q"), "left")
    target = F.coalesce("direct", "q", F.when(F.col("wild"), F.col("target")).otherwise(F.col("short")))
    return found.select("module", target.alias("target"), (F.col("direct").isNull() & F.col("q").isNull()).alias("is_external")).distinct()


def class_names(f: Facts, wanted: DataFrame) -> DataFrame:
    """(`module`, `name`, `target`): the definition that a class's name means in a module.

    An import comes first, then the module itself, then the modules around it from the nearest outwards, then the first
    definition of that name.
    """
    wanted = wanted.select("module", "name").where("name is not null").distinct()
    known = f.definitions.where("label <> 'Module'").select(F.col("qualified_name").alias("target"), F.col("name").alias("simple"), "label")
    head, tail = F.split("name", r"\.")[0], F.regexp_replace("name", r"^[^.]*", "")
    imports = f.imports.select("module", F.col("name").alias("head"), F.col("target").alias("base"))
    tiers = [wanted.withColumns({"head": head, "tail": tail}).join(imports, ["module", "head"]).select("module", "name", F.concat("base", "tail").alias("target"), F.lit(0).alias("tier"), F.lit(0).alias("ord"))]
    parts = F.split("module", r"\.")
    outer = wanted.withColumn("n", F.explode(F.sequence(F.size(parts), F.lit(1), F.lit(-1))))
    tiers.append(outer.select("module", "name", F.concat_ws(".", F.array_join(F.slice(F.split("module", r"\."), 1, F.col("n")), "."), "name").alias("target"), F.when(F.col("n") == F.size(F.split("module", r"\.")), 1).otherwise(2).alias("tier"), (-F.col("n")).alias("ord")))
    found = tiers[0].unionByName(tiers[1]).join(known.select("target", F.lit(True).alias("there")), "target", "left")
    # Imports of what no file defines stay as they are, as the name of an external class.
    found = found.where("there or tier = 0").withColumn("tier", F.when(F.col("there"), F.col("tier")).otherwise(3)).drop("there")
    classes = known.where("label in ('Class', 'Interface', 'Enum', 'Union', 'Type')").groupBy("simple").agg(F.min("target").alias("target"))
    any_ = wanted.withColumn("simple", last_part(F.col("name"))).join(classes, "simple").select("module", "name", "target", F.lit(4).alias("tier"), F.lit(0).alias("ord"))
    return _best(found.unionByName(any_), ["module", "name"]).select("module", "name", "target")


def parents(f: Facts) -> DataFrame:
    """(`src`, `dst`, `ord`, `type`): INHERITS and IMPLEMENTS edges by name; an unknown base is named below the module."""
    named = class_names(f, f.inherits)
    rows = f.inherits.join(named, ["module", "name"], "left").withColumn("dst", F.coalesce("target", F.concat_ws(".", "module", "name")))
    label = f.definitions.select(F.col("qualified_name").alias("dst"), "label")
    source = f.definitions.select(F.col("qualified_name").alias("class"), F.col("label").alias("own"))
    rows = rows.join(label, "dst", "left").join(source, "class", "left")
    kind = F.when((F.col("label") == "Interface") & (F.coalesce("own", F.lit("Class")) != "Interface"), "IMPLEMENTS").otherwise("INHERITS")
    return rows.select(F.col("class").alias("src"), "dst", "ord", kind.alias("type"), F.coalesce("label", F.lit("Class")).alias("target_label")).distinct()


def overrides(f: Facts, up: DataFrame) -> DataFrame:
    """(`method`, `overridden`): the first ancestor's method of the same name in breadth-first order."""
    own = f.definitions.where("label = 'Method'").select(F.col("parent").alias("start"), "name", F.col("qualified_name").alias("method"))
    hits = own.select(F.col("start").alias("id"), "name")
    found = nearest_hits(own, up.select("src", "dst", "ord"), hits).where("start <> id")
    above = own.select(F.col("start").alias("id"), "name", F.col("method").alias("overridden"))
    return own.join(found, ["start", "name"]).join(above, ["id", "name"]).select("method", "overridden").distinct()


def resolve_calls(f: Facts, up: DataFrame) -> DataFrame:
    """(`caller`, `name`, `line`, `target`, `tier`): the definition of each call; `target` is null if none is found.

    Tiers: 0 super, 1 import, 2 method of a variable's type, 3 attribute of an import or of the module, 4 the class's own or
    an inherited method, 5 wildcard import, 6 same module, 7 a function of JavaScript itself, 8 the nearest definition of that name. A super call is answered
    by tier 0 or not at all.
    """
    parts, last = F.split("name", r"\."), last_part(F.col("name"))
    n, head = F.size(parts), F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")
    is_super, class_ = F.col("name").startswith("super()"), F.coalesce("class", F.lit("")).alias("class")
    known = f.definitions.where("label <> 'Module'").select(F.col("qualified_name").alias("target"), F.col("name").alias("simple"), "label")

    # Most tiers depend on the module and the name alone. All candidates of a name meet the definitions in one join.
    def option(when: Column, target: Column, tier: int, order: int | Column = 0) -> Column:
        value = F.struct(target.alias("target"), F.lit(tier).alias("tier"), (order if isinstance(order, Column) else F.lit(order)).cast("int").alias("ord"))
        return F.when(when, value)

    imports = f.imports.select("module", F.col("name").alias("local"), F.col("target").alias("base"), F.col("ord").alias("at"))
    wild = imports.where("local like '*%'").groupBy("module").agg(F.collect_list(F.struct("base", "at")).alias("wild"))
    scripts = f.definitions.where("label = 'Module'").where(F.col("path").rlike(r"(?i)\.(jsx?|tsx?|[mc][jt]s)$")).select(F.col("qualified_name").alias("module"), F.lit(True).alias("script"))
    asks = f.calls.where(~is_super).select("module", "name").distinct().withColumn("local", F.when(n == 1, F.col("name")).when(n == 2, head))
    asks = asks.join(imports.where("local not like '*%'").drop("at"), ["module", "local"], "left").join(wild, "module", "left").join(scripts, "module", "left")
    own, is_import = F.concat_ws(".", "module", "name"), F.col("base").isNotNull()
    options = F.array(
        option((n == 1) & is_import, F.col("base"), 1),
        option((n == 2) & is_import, F.concat_ws(".", F.col("base"), last), 3, 0),
        option(n == 2, own, 3, 1),
        option(n == 1, own, 6),
        option(F.col("script") & builtin_target(F.col("name")).isNotNull(), builtin_target(F.col("name")), 7),
    )
    of_wild = F.when(n == 1, F.transform("wild", lambda w: option(F.lit(True), F.concat_ws(".", w["base"], F.col("name")), 5, w["at"])))
    options = F.filter(F.concat(options, F.coalesce(of_wild, F.array().cast("array<struct<target:string,tier:int,ord:int>>"))), lambda x: x.isNotNull())
    asks = asks.select("module", "name", F.explode_outer(options).alias("o")).select("module", "name", "o.*")
    there = F.when(F.col("there") | (F.col("tier") == 7), F.struct("tier", "ord", "target"))
    flat = asks.join(known.select("target", F.lit(True).alias("there")), "target", "left").groupBy("module", "name").agg(F.min(there).alias("b"))
    flat = cut(flat.withColumn("last", last))
    # Methods: on a variable's type, on self, or on the parent of a class; a class stands for its own and inherited methods.
    keys = ["module", "caller", "name", "class"]
    dotted = f.calls.where(n >= 2).select(*keys).distinct()
    places = [F.struct(F.col(c).alias("scope"), F.lit(i).alias("ord")) for i, c in enumerate(("caller", "class", "module"))]
    scopes = f.calls.select("module", F.explode(F.array("caller", "class", "module")).alias("scope")).distinct()
    typed = scopes.join(_typed(f), "scope").groupBy("module", "variable").agg(F.collect_set(F.struct("scope", "of")).alias("typed"))
    fits = F.flatten(F.transform(F.array(*places), lambda p: F.transform(F.filter("typed", lambda t: t["scope"] == p["scope"]), lambda t: F.struct(t["of"].alias("owner"), p["ord"].alias("ord")))))
    on_type = dotted.where(~is_super).withColumn("variable", head).join(typed, ["module", "variable"]).select("module", "caller", "name", "class", F.explode(fits).alias("o"))
    on_type = on_type.select("module", "caller", "name", class_, last.alias("last"), "o.owner", F.lit(2).alias("tier"), "o.ord")
    inner = dotted.where("class is not null")
    on_self = inner.where((n == 2) & head.isin("self", "cls", "this")).select(*keys, last.alias("last"), F.col("class").alias("owner"), F.lit(4).alias("tier"), F.lit(0).alias("ord"))
    on_super = inner.where(is_super).join(up.select(F.col("src").alias("class"), F.col("dst").alias("owner"), F.col("ord").alias("o")), "class").select(*keys, last.alias("last"), "owner", F.lit(0).alias("tier"), F.col("o").cast("int").alias("ord"))
    of_class = cut(on_type.unionByName(on_self).unionByName(on_super))
    methods = f.definitions.where("label in ('Method', 'Function')").select(F.col("parent").alias("id"), "name", F.col("qualified_name").alias("target"))
    found = nearest_hits(of_class.select(F.col("owner").alias("start"), F.col("last").alias("name")), up.select("src", "dst", "ord"), methods.select("id", "name"), own=True)
    held = found.join(methods, ["id", "name"]).select(F.col("start").alias("owner"), F.col("name").alias("last"), "target")
    deep = of_class.join(held, ["owner", "last"]).groupBy(*keys).agg(F.min(F.struct("tier", "ord", "target")).alias("d"))
    # Only names that no tier answers look for the nearest definition.
    names = known.where("label <> 'Class'").select(F.col("simple").alias("name"), F.col("target").alias("qualified_name"))
    near = nearest(flat.where("b is null").select(F.col("module").alias("caller"), F.col("last").alias("name")), names).select(F.col("caller").alias("module"), F.col("name").alias("last"), F.col("candidate").alias("near"))
    far = F.when(F.col("near").isNotNull(), F.struct(F.lit(8).alias("tier"), F.lit(0).alias("ord"), F.col("near").alias("target")))
    flat = flat.join(near, ["module", "last"], "left").select("module", "name", F.coalesce("b", far).alias("b")).where("b is not null")
    all_ = f.calls.select("module", "caller", "name", class_, "line").join(flat, ["module", "name"], "left").join(deep, keys, "left")
    return all_.withColumn("b", F.least("b", "d")).select("caller", "name", "line", "b.target", "b.tier").distinct()


def _typed(f: Facts) -> DataFrame:
    """(`scope`, `variable`, `of`): variables with the class of their type."""
    wanted = f.variables.select("module", F.col("target").alias("name"))
    named = class_names(f, wanted).select("module", F.col("name").alias("target"), F.col("target").alias("of"))
    return f.variables.join(named, ["module", "target"]).select("scope", F.col("name").alias("variable"), "of")


def call_edges(resolved: DataFrame) -> DataFrame:
    """(`src`, `dst`, `n`) of the calls that were resolved."""
    return resolved.where("target is not null").groupBy(F.col("caller").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("n"))


def definition_edges(f: Facts) -> DataFrame:
    """(`src`, `dst`, `type`) of modules and functions to what they define, and of classes to their methods."""
    rows = f.definitions.where("parent is not null")
    return rows.select(F.col("parent").alias("src"), F.col("qualified_name").alias("dst"), F.when(F.col("label") == "Method", "DEFINES_METHOD").otherwise("DEFINES").alias("type"))


# Functions of JavaScript itself, and methods that every function has.
SCRIPT_BUILTINS = (
    "Object.create Object.keys Object.values Object.entries Object.assign Object.freeze Object.seal Object.defineProperty Object.getPrototypeOf Object.setPrototypeOf Array.from Array.of Array.isArray parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent "
    "setTimeout clearTimeout setInterval clearInterval console.log console.error console.warn console.info console.debug JSON.parse JSON.stringify Math.random Math.floor Math.ceil Math.round Math.abs Math.max Math.min Date.now Date.parse"
).split()
FUNCTION_METHODS = ["bind", "call", "apply"]


def builtin_target(call: Column) -> Column:
    """The `builtin.` name that a JavaScript call without a definition means: a function of the language, or a function's own method."""
    last = F.element_at(F.split(call, r"\."), -1)
    own = call.contains(".") & last.isin(FUNCTION_METHODS)
    return F.when(call.isin(SCRIPT_BUILTINS), F.concat(F.lit("builtin."), call)).when(own, F.concat(F.lit("builtin.Function.prototype."), last))


def ranked_modules(candidates: DataFrame) -> DataFrame:
    """(`class`, `module`, `candidate`, `place`) for (`class`, `module`, `candidate`, `path`, `ord`): in which order modules are tried.

    First those whose dotted `path` is the class's name, then those with which it ends, then others; within these the
    nearest to the `module` that asks, then in their own order.
    """
    wanted, path = F.col("class"), F.col("path")
    penalty = F.when(path == wanted, 0).when((path != "") & wanted.endswith(path), 1).otherwise(2)
    order = Window.partitionBy("class", "module").orderBy(penalty, module_distance(F.col("candidate"), F.col("module")), "ord")
    return candidates.withColumn("place", F.row_number().over(order)).select("class", "module", "candidate", "place")


def operator_targets(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(`module`, `name`, `target`) of C++ operator calls (`module`, `name` like `operator_plus`): the shortest, then first definition.

    Definitions of the module go before others.
    """
    defs = definitions.select("name", "qualified_name").where("name like 'operator%'").distinct()
    hits = calls.select("module", "name").distinct().join(defs, "name")
    away = ~F.col("qualified_name").startswith(F.col("module"))
    return hits.groupBy("module", "name").agg(F.min(F.struct(away.alias("away"), F.length("qualified_name").alias("n"), "qualified_name")).alias("b")).select("module", "name", F.col("b.qualified_name").alias("target"))
