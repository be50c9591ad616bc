"""A subset of openCypher as DataFrame plans.

Reads: MATCH, OPTIONAL MATCH, WHERE, WITH, UNWIND of a list parameter, RETURN [DISTINCT], ORDER BY, SKIP, LIMIT; patterns
with labels, property maps, directed, undirected and variable-length relationships. Variable length means reachability, so
each pair of ends comes once. Writes (`execute`): CREATE, MERGE, SET +=, DELETE and DETACH DELETE in the forms of the
batch statements. Anything else raises `Unsupported`. Nulls order last when ascending and first when descending.

A binding table has the columns `v.node_id`, `v.labels`, ... of each node variable and `r.rel_id`, ... of each relationship;
what isn't used is pruned by Catalyst.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.traverse import both_ways, reachable

# Keywords that a read may not hold, anywhere in its text.
WRITES = ["CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "CALL", "LOAD CSV", "FOREACH", "GRANT", "REVOKE", "DENY", "ALTER"]
_TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\d+\.\d+|\d+|\.\.|\$\w+|`[^`]+`|[A-Za-z_]\w*|<>|<=|>=|=~|\+=|->|<-|[-+*/%=<>()\[\]{},.:|;])", re.S)


class Unsupported(ValueError):
    """The text is outside the subset."""


def read_only(text: str) -> None:
    """Raises if the text holds a writing keyword; comments between the words of one don't hide it."""
    bare = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S).upper()
    for word in WRITES:
        if re.search(r"(?<![A-Z0-9_])" + r"\s+".join(word.split()) + r"(?![A-Z0-9_])", bare):
            raise Unsupported(f"{word} is not allowed in a read")


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unsupported(f"cannot read {text[at : at + 20]!r}")
        if m[1]:
            out.append(m[1])
        at = m.end()
    return out


@dataclass
class Node:
    name: str
    labels: list[str]
    properties: dict[str, tuple]


@dataclass
class Step:
    name: str
    types: list[str]
    direction: str
    hops: tuple[int, int | None] | None
    properties: dict[str, tuple] = field(default_factory=dict)


class Parser:
    """Recursive descent to tuples: ("prop", var, name), ("call", name, distinct, args), ("op", sign, left, right), ..."""

    def __init__(self, text: str) -> None:
        self.t, self.i, self.fresh = tokens(text), 0, itertools.count()

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k] if self.i + k < len(self.t) else ""

    def word(self, *words: str) -> bool:
        if [self.peek(k).upper() for k in range(len(words))] == list(words):
            self.i += len(words)
            return True
        return False

    def take(self, expected: str | None = None) -> str:
        t = self.peek()
        if not t or (expected and t.upper() != expected):
            raise Unsupported(f"{expected or 'more'} expected at {' '.join(self.t[self.i : self.i + 4])!r}")
        self.i += 1
        return t

    def name(self) -> str:
        t = self.take()
        if not re.match(r"[A-Za-z_`]", t):
            raise Unsupported(f"a name expected, not {t!r}")
        return t.strip("`")

    def clauses(self) -> list[tuple]:
        out: list[tuple] = []
        while self.i < len(self.t):
            if self.word(";"):
                continue
            if self.word("OPTIONAL", "MATCH"):
                out.append(("match", True, self.patterns(), self.where()))
            elif self.word("MATCH"):
                out.append(("match", False, self.patterns(), self.where()))
            elif self.word("UNWIND"):
                e = self.expression()
                self.take("AS")
                out.append(("unwind", e, self.name()))
            elif self.word("DETACH", "DELETE"):
                out.append(("delete", True, self.names()))
            elif self.word("DELETE"):
                out.append(("delete", False, self.names()))
            elif self.word("WITH"):
                out.append(("with", *self.projection(), self.where()))
            elif self.word("RETURN"):
                out.append(("return", *self.projection(), None))
            else:
                raise Unsupported(f"clause {self.peek()!r}")
        return out

    def names(self) -> list[str]:
        out = [self.name()]
        while self.word(","):
            out.append(self.name())
        return out

    def where(self) -> tuple | None:
        return self.expression() if self.word("WHERE") else None

    def projection(self) -> tuple:
        distinct, items = self.word("DISTINCT"), []
        while True:
            start = self.i
            e = self.expression()
            text = "".join(self.t[start : self.i]) if len(self.t[start : self.i]) > 1 else self.t[start]
            items.append((self.name() if self.word("AS") else text, e))
            if not self.word(","):
                break
        order, skip, limit = [], None, None
        if self.word("ORDER", "BY"):
            while True:
                e = self.expression()
                order.append((e, self.word("DESC") or self.word("DESCENDING") or (self.word("ASC") or self.word("ASCENDING")) and False))
                if not self.word(","):
                    break
        if self.word("SKIP"):
            skip = self.expression()
        if self.word("LIMIT"):
            limit = self.expression()
        return distinct, items, order, skip, limit

    def patterns(self) -> list[list]:
        out = [self.path()]
        while self.word(","):
            out.append(self.path())
        return out

    def path(self) -> list:
        out: list = [self.node()]
        while self.peek() in ("-", "<-"):
            left = self.take() == "<-"
            step = Step(f"_r{next(self.fresh)}", [], "", None)
            if self.word("["):
                if re.match(r"[A-Za-z_]", self.peek()):
                    step.name = self.name()
                if self.word(":"):
                    step.types.append(self.name())
                    while self.word("|"):
                        self.word(":")
                        step.types.append(self.name())
                if self.word("*"):
                    low = int(self.take()) if self.peek().isdigit() else None
                    high = low
                    if self.word(".."):
                        high = int(self.take()) if self.peek().isdigit() else None
                        low = 1 if low is None else low
                    step.hops = (1, None) if low is None else (low, high)
                if self.peek() == "{":
                    step.properties = self.map()
                self.take("]")
            right = self.peek() == "->"
            if self.take() not in ("->", "-"):
                raise Unsupported("an arrow expected")
            step.direction = "<" if left and not right else ">" if right and not left else "-"
            out += [step, self.node()]
        return out

    def node(self) -> Node:
        self.take("(")
        node = Node(f"_n{next(self.fresh)}", [], {})
        if re.match(r"[A-Za-z_]", self.peek()):
            node.name = self.name()
        while self.word(":") or (node.labels and self.word("|")):
            node.labels.append(self.name())
        if self.peek() == "{":
            node.properties = self.map()
        self.take(")")
        return node

    def map(self) -> dict[str, tuple]:
        self.take("{")
        out = {}
        while not self.word("}"):
            key = self.name()
            self.take(":")
            out[key] = self.expression()
            self.word(",")
        return out

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.word("OR"):
            left = ("op", "OR", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.negation()
        while self.word("AND"):
            left = ("op", "AND", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> tuple:
        left = self.sum()
        while True:
            if self.word("IS", "NOT", "NULL"):
                left = ("null", left, False)
            elif self.word("IS", "NULL"):
                left = ("null", left, True)
            elif self.word("STARTS", "WITH"):
                left = ("op", "STARTS", left, self.sum())
            elif self.word("ENDS", "WITH"):
                left = ("op", "ENDS", left, self.sum())
            elif self.word("CONTAINS"):
                left = ("op", "CONTAINS", left, self.sum())
            elif self.word("IN"):
                left = ("op", "IN", left, self.sum())
            elif self.peek() in ("=", "<>", "<", ">", "<=", ">=", "=~"):
                left = ("op", self.take(), left, self.sum())
            else:
                return left

    def sum(self) -> tuple:
        left = self.product()
        while self.peek() in ("+", "-"):
            left = ("op", self.take(), left, self.product())
        return left

    def product(self) -> tuple:
        left = self.atom()
        while self.peek() in ("*", "/", "%"):
            left = ("op", self.take(), left, self.atom())
        return left

    def atom(self) -> tuple:
        t = self.take()
        if t[0] in "'\"":
            e: tuple = ("lit", re.sub(r"\\(.)", r"\1", t[1:-1]))
        elif t[0].isdigit():
            e = ("lit", float(t) if "." in t else int(t))
        elif t == "-":
            e = ("op", "-", ("lit", 0), self.atom())
        elif t[0] == "$":
            e = ("param", t[1:])
        elif t == "[":
            items = []
            while not self.word("]"):
                items.append(self.expression())
                self.word(",")
            e = ("list", items)
        elif t == "(":
            e = self.expression()
            self.take(")")
        elif t.upper() in ("TRUE", "FALSE", "NULL"):
            e = ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[t.upper()])
        elif t.upper() in ("ANY", "ALL", "NONE") and self.peek() == "(":
            self.take("(")
            var = self.name()
            self.take("IN")
            source = self.expression()
            self.take("WHERE")
            e = ("each", t.upper(), var, source, self.expression())
            self.take(")")
        elif self.peek() == "(":
            self.take("(")
            distinct, args = self.word("DISTINCT"), []
            while not self.word(")"):
                args.append(("star",) if self.word("*") else self.expression())
                self.word(",")
            e = ("call", t.lower(), distinct, args)
        elif re.match(r"[A-Za-z_`]", t):
            e = ("var", t.strip("`"))
        else:
            raise Unsupported(f"unexpected {t!r}")
        while True:
            if self.peek() == "." and e[0] == "var":
                self.take()
                e = ("prop", e[1], self.name())
            elif self.peek() == ":" and e[0] == "var":
                self.take()
                e = ("labelled", e[1], self.name())
            elif self.peek() == "[":
                self.take()
                e = ("at", e, self.expression())
                self.take("]")
            else:
                return e


AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}
_NODE, _EDGE = ["node_id", "labels", "properties", "project"], ["rel_id", "from_id", "to_id", "type", "properties"]


def _aggregates(e: object) -> bool:
    return isinstance(e, tuple) and (e[:1] == ("call",) and e[1] in AGGREGATES or any(_aggregates(x) for x in e)) or isinstance(e, list) and any(_aggregates(x) for x in e)


class Planner:
    def __init__(self, graph, params: dict) -> None:  # noqa: ANN001
        self.graph, self.params = graph, params
        self.table: DataFrame | None = None
        self.nodes: set[str] = set()
        self.edges: set[str] = set()
        self.values: set[str] = set()

    # Expressions.
    def column(self, e: tuple, local: dict[str, Column] | None = None) -> Column:
        kind, local = e[0], local or {}
        c = lambda x: self.column(x, local)
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            if e[1] not in self.params:
                raise Unsupported(f"no parameter {e[1]}")
            v = self.params[e[1]]
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if kind == "list":
            return F.array(*map(c, e[1]))
        if kind == "var":
            if e[1] in local:
                return local[e[1]]
            if e[1] in self.nodes:
                return F.struct(*(F.col(f"`{e[1]}.{x}`").alias(x) for x in _NODE))
            if e[1] in self.edges:
                return F.struct(*(F.col(f"`{e[1]}.{x}`").alias(x) for x in _EDGE))
            return F.col(f"`{e[1]}`")
        if kind == "prop":
            return self.property(e[1], e[2])
        if kind == "labelled":
            return F.array_contains(F.col(f"`{e[1]}.labels`"), e[2])
        if kind == "not":
            return ~c(e[1])
        if kind == "null":
            target = F.col(f"`{e[1][1]}.{'node_id' if e[1][1] in self.nodes else 'rel_id'}`") if e[1][0] == "var" and e[1][1] in self.nodes | self.edges else c(e[1])
            return target.isNull() if e[2] else target.isNotNull()
        if kind == "at":
            return F.get(c(e[1]), c(e[2]).cast("int"))
        if kind == "each":
            test = lambda x: self.column(e[4], local | {e[2]: x})
            items = self.listed(e[3], c)
            return F.exists(items, test) if e[1] == "ANY" else F.forall(items, test) if e[1] == "ALL" else ~F.exists(items, test)
        if kind == "op":
            return self.operator(e[1], e[2], e[3], c)
        if kind == "call":
            return self.call(e, c)
        raise Unsupported(str(kind))

    def property(self, var: str, name: str) -> Column:
        if var not in self.nodes | self.edges:
            if var in self.values:
                return F.col(f"`{var}`")[name]
            raise Unsupported(f"{var} is not bound")
        source = self.graph.nodes if var in self.nodes else self.graph.edges
        if name in source.columns and name not in ("node_id", "labels", "properties", "rel_id", "from_id", "to_id", "type"):
            return F.col(f"`{var}.{name}`")
        return F.try_element_at(F.col(f"`{var}.properties`"), F.lit(name))

    def listed(self, e: tuple, c) -> Column:  # noqa: ANN001
        """A list; the text of a property is read as a JSON list, which is how lists are stored (null if it is none)."""
        return F.from_json(c(e), "array<string>") if e[0] == "prop" and (e[1] in self.nodes or e[1] in self.edges) else c(e)

    def operator(self, sign: str, a: tuple, b: tuple, c) -> Column:  # noqa: ANN001
        if sign == "IN" and b[0] == "list":
            return c(a).isin(*[x[1] if x[0] == "lit" else c(x) for x in b[1]]) if b[1] else F.lit(False)
        if sign == "IN":
            return F.array_contains(self.listed(b, c), c(a))
        x, y = c(a), c(b)
        table = {"OR": lambda: x | y, "AND": lambda: x & y, "=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y, "STARTS": lambda: x.startswith(y), "ENDS": lambda: x.endswith(y), "CONTAINS": lambda: x.contains(y), "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y, "=~": lambda: F.regexp_like(x, F.concat(F.lit("^(?:"), y, F.lit(")$")))}
        return table[sign]()

    def call(self, e: tuple, c) -> Column:  # noqa: ANN001
        _, name, distinct, args = e
        if name == "count":
            if args[0] == ("star",):
                return F.count(F.lit(1))
            v = args[0]
            col = F.col(f"`{v[1]}.{'node_id' if v[1] in self.nodes else 'rel_id'}`") if v[0] == "var" and v[1] in self.nodes | self.edges else c(v)
            return F.count_distinct(col) if distinct else F.count(col)
        var = args[0][1] if args and args[0][0] == "var" else None
        if name == "id" and var in self.nodes:
            return F.col(f"`{var}.node_id`")
        if name == "id" and var in self.edges:
            return F.col(f"`{var}.rel_id`")
        if name == "labels":
            return F.col(f"`{var}.labels`")
        if name == "type":
            return F.col(f"`{var}.type`")
        if name == "properties":
            return F.col(f"`{var}.properties`")
        plain = {"tolower": F.lower, "toupper": F.upper, "size": F.size, "trim": F.trim, "tostring": lambda x: x.cast("string"), "tointeger": lambda x: x.try_cast("bigint"), "tofloat": lambda x: x.try_cast("double"), "abs": F.abs, "head": lambda x: F.get(x, F.lit(0)), "length": F.size, "avg": F.avg, "min": F.min, "max": F.max, "keys": F.map_keys}
        if name in plain:
            return plain[name](c(args[0]))
        if name == "sum":
            return F.sum_distinct(c(args[0])) if distinct else F.sum(c(args[0]))
        if name == "collect":
            return F.sort_array(F.collect_set(c(args[0])) if distinct else F.collect_list(c(args[0])))
        if name == "coalesce":
            return F.coalesce(*map(c, args))
        raise Unsupported(f"function {name}")

    # Patterns.
    def scan(self, node: Node) -> DataFrame:
        rows = self.graph.labelled(*node.labels) if node.labels else self.graph.nodes
        rows = rows.select(*(F.col(x).alias(f"{node.name}.{x}") for x in rows.columns))
        return rows

    def fits(self, node: Node) -> list[Column]:
        out = [F.arrays_overlap(F.col(f"`{node.name}.labels`"), F.array(*map(F.lit, node.labels)))] if node.labels else []
        return out + [self.property(node.name, k) == self.column(v) for k, v in node.properties.items()]

    def match(self, patterns: list[list], where: tuple | None, bound: set[str]) -> DataFrame:
        """The rows of the patterns alone; variables of `bound` are scanned again, to be joined by their ids."""
        table, here, fixed = None, set(), []
        for path in sorted(patterns, key=lambda p: 0 if any(isinstance(x, Node) and x.name in bound for x in p) else 1):
            first, last = path[0].name, path[-1].name
            if (first not in here and last in here) or (not here and first not in bound and last in bound):
                path = [replace(x, direction={"<": ">", ">": "<", "-": "-"}[x.direction]) if isinstance(x, Step) else x for x in reversed(path)]
            first = path[0]
            if first.name in here and table is not None:
                rows = table
            else:
                self.nodes.add(first.name)
                here.add(first.name)
                scan = self.scan(first)
                if first.name in bound and self.table is not None:  # only from what is bound already
                    ids = self.table.select(F.col(f"`{first.name}.node_id`").alias("_id")).distinct()
                    scan = scan.join(ids, F.col(f"`{first.name}.node_id`") == F.col("_id"), "left_semi")
                for test in self.fits(first):
                    scan = scan.where(test)
                if table is None:
                    rows = scan
                else:
                    raise Unsupported("patterns without a common variable")
            for k in range(1, len(path), 2):
                rows = self.expand(rows, path[k - 1], path[k], path[k + 1], here, fixed)
            table = rows
        for a, b in itertools.combinations(fixed, 2):
            table = table.where(F.col(f"`{a}.rel_id`") != F.col(f"`{b}.rel_id`"))
        return table.where(self.column(where)) if where else table

    def expand(self, rows: DataFrame, left: Node, step: Step, right: Node, here: set[str], fixed: list[str]) -> DataFrame:
        edges = self.graph.edges.where(F.col("type").isin(*step.types)) if step.types else self.graph.edges
        at = F.col(f"`{left.name}.node_id`")
        if step.hops is None:
            self.edges.add(step.name)
            fixed.append(step.name)
            named = edges.select(*(F.col(x).alias(f"{step.name}.{x}") for x in edges.columns))
            src, dst = f"{step.name}.from_id", f"{step.name}.to_id"
            if step.direction == "<":
                src, dst = dst, src
            if step.direction == "-":
                back = named.withColumns({"_src": F.col(f"`{dst}`"), "_dst": F.col(f"`{src}`")})
                named = named.withColumns({"_src": F.col(f"`{src}`"), "_dst": F.col(f"`{dst}`")}).unionByName(back.where("_src <> _dst"))
            else:
                named = named.withColumns({"_src": F.col(f"`{src}`"), "_dst": F.col(f"`{dst}`")})
            rows = rows.join(named, at == F.col("_src")).drop("_src")
            for k, v in step.properties.items():
                rows = rows.where(self.property(step.name, k) == self.column(v))
        else:
            ids = self.graph.nodes.select("node_id")  # no walk leads over a node that doesn't exist
            edges = edges.join(ids, F.col("from_id") == F.col("node_id"), "left_semi").join(ids, F.col("to_id") == F.col("node_id"), "left_semi")
            steps = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
            if step.direction == "<":
                steps = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            if step.direction == "-":
                steps = both_ways(steps)
            low, high = step.hops
            if low > 1:
                raise Unsupported("variable length from more than one hop")
            pairs = reachable(rows.select(at.alias("start")), steps, low, high).select(F.col("start").alias("_src"), F.col("id").alias("_dst"))
            rows = rows.join(pairs, at == F.col("_src")).drop("_src")
        if right.name in here:
            rows = rows.where(F.col("_dst") == F.col(f"`{right.name}.node_id`")).drop("_dst")
        else:
            here.add(right.name)
            self.nodes.add(right.name)
            rows = rows.join(self.scan(right), F.col("_dst") == F.col(f"`{right.name}.node_id`")).drop("_dst")
        for test in self.fits(right):
            rows = rows.where(test)
        return rows

    # Clauses.
    def run(self, clauses: list[tuple]) -> DataFrame:
        if not clauses or clauses[-1][0] != "return":
            raise Unsupported("a read ends with RETURN")
        for clause in clauses:
            getattr(self, f"_{clause[0]}")(*clause[1:])
        return self.table

    def _match(self, optional: bool, patterns: list[list], where: tuple | None) -> None:
        before = set(self.nodes)
        names = {x.name for p in patterns for x in p if isinstance(x, Node)}
        shared = sorted(names & before)
        found = self.match(patterns, where, set(shared))
        if self.table is None:
            self.table = found
            return
        if not shared:
            raise Unsupported("a MATCH that shares no variable with the ones before")
        keys = {n: f"_{n}" for n in shared}
        found = found.withColumns({k: F.col(f"`{n}.node_id`") for n, k in keys.items()})
        found = found.drop(*(c for c in found.columns if any(c.startswith(f"{n}.") for n in shared)))
        on = reduce(lambda a, b: a & b, (F.col(f"`{n}.node_id`") == F.col(f"`{k}`") for n, k in keys.items()))
        self.table = self.table.join(found, on, "left" if optional else "inner").drop(*keys.values())

    def _unwind(self, e: tuple, name: str) -> None:
        rows = self.params.get(e[1]) if e[0] == "param" else [x[1] for x in e[1]] if e[0] == "list" else None
        if rows is None or self.table is not None:
            raise Unsupported("UNWIND of anything but a list at the start")
        spark = self.graph.nodes.sparkSession
        self.table = spark.createDataFrame([(r,) for r in rows], [name]) if rows else spark.createDataFrame([], f"`{name}` string")
        self.values.add(name)

    def _with(self, distinct: bool, items: list, order: list, skip: tuple | None, limit: tuple | None, where: tuple | None) -> None:
        kept = {n for n, e in items if e[0] == "var" and e[1] in self.nodes | self.edges and n == e[1]}
        self._project(distinct, items, order, skip, limit, kept)
        self.nodes, self.edges = self.nodes & kept, self.edges & kept
        self.values = {n for n, _ in items} - kept
        if where:
            self.table = self.table.where(self.column(where))

    def _return(self, distinct: bool, items: list, order: list, skip: tuple | None, limit: tuple | None, _: None) -> None:
        self._project(distinct, items, order, skip, limit, set())

    def _project(self, distinct: bool, items: list, order: list, skip: tuple | None, limit: tuple | None, kept: set[str]) -> None:
        out: list[Column] = []
        keys: list[Column] = []
        totals: list[Column] = []
        for name, e in items:
            if name in kept:
                cols = [F.col(f"`{c}`") for c in self.table.columns if c.startswith(f"{name}.")]
                keys += cols
                out += cols
            elif _aggregates(e):
                totals.append(self.column(e).alias(name))
                out.append(F.col(f"`{name}`"))
            else:
                keys.append(self.column(e).alias(name))
                out.append(self.column(e).alias(name))
        names = {n for n, _ in items}
        spoken = {str(e): n for n, e in items}
        sort, hidden = [], []
        for k, (e, down) in enumerate(order):
            if e[0] == "var" and e[1] in names:
                c = F.col(f"`{e[1]}`")
            elif str(e) in spoken:
                c = F.col(f"`{spoken[str(e)]}`")
            elif totals or distinct:
                raise Unsupported("ORDER BY of what isn't returned")
            else:
                hidden.append(self.column(e).alias(f"_o{k}"))
                c = F.col(f"_o{k}")
            sort.append(c.desc_nulls_first() if down else c.asc_nulls_last())
        if totals:
            grouped = self.table.groupBy(*keys) if keys else self.table.groupBy()
            plain = [F.col(f"`{n}`") if n not in kept else None for n, _ in items]
            rows = grouped.agg(*totals)
            rows = rows.select(*(x for n, x in zip(items, plain) if x is not None), *(F.col(f"`{c}`") for c in rows.columns if c.split(".")[0] in kept))
        else:
            rows = self.table.select(*out, *hidden)
        if distinct:
            rows = rows.distinct()
        if sort:
            rows = rows.orderBy(*sort)
        number = lambda e: e[1] if e[0] == "lit" else int(self.params[e[1]])
        if skip is not None:
            rows = rows.offset(number(skip))
        if limit is not None:
            rows = rows.limit(number(limit))
        self.table = rows.drop(*(f"_o{k}" for k in range(len(order))))


def query(graph, text: str, params: dict | None = None) -> DataFrame:  # noqa: ANN001
    """The result of a read."""
    read_only(text)
    return Planner(graph, params or {}).run(Parser(text).clauses())


_MERGE_NODE = re.compile(r"\s*UNWIND\s+\$(\w+)\s+AS\s+(\w+)\s+(MERGE|CREATE)\s*\(\s*(\w+)\s*:\s*(\w+)\s*\{\s*(\w+)\s*:\s*\2\.(\w+)\s*\}\s*\)\s*(?:SET\s+\4\s*\+=\s*\2\.(\w+)\s*)?;?\s*$", re.I | re.S)
_END = r"\(\s*(\w+)\s*:\s*(\w+)\s*\{\s*(\w+)\s*:\s*%s\.(\w+)\s*\}\s*\)"
_MERGE_EDGE = re.compile(
    r"\s*UNWIND\s+\$(?P<batch>\w+)\s+AS\s+(?P<row>\w+)\s+MATCH\s*" + _END % "(?P=row)" + r"\s*,\s*" + _END % "(?P=row)" + r"\s*(?P<verb>MERGE|CREATE)\s*\(\s*\w+\s*\)\s*-\s*\[\s*(?P<rel>\w+)\s*:\s*(?P<type>\w+)\s*\]\s*->\s*\(\s*\w+\s*\)\s*(?:SET\s+\w+\s*\+=\s*(?P=row)\.(?P<props>\w+)\s*)?(?:RETURN\s+count\(\s*\w+\s*\)\s+AS\s+(?P<created>\w+)\s*)?;?\s*$",
    re.I | re.S,
)


def _text(value: object) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _write_nodes(graph, m: re.Match, params: dict):  # noqa: ANN001, ANN202
    from canopy.operators import mutate

    batch, _, verb, _, label, key, field_, props = m.groups()
    spark = graph.nodes.sparkSession
    rows = [(k, r) for k, r in enumerate(params[batch]) if r.get(field_) is not None]
    if verb.upper() == "CREATE":
        made = [(label, {key: str(r[field_]), **{k: _text(v) for k, v in (r.get(props) or {}).items() if v is not None}}, n) for n, r in rows]
        return mutate.create_nodes(graph, spark.createDataFrame(made, "label string, properties map<string,string>, seq bigint"))
    stage = [(label, str(r[field_]), p, _text(v), n) for n, r in rows for p, v in {**(r.get(props) or {} if props else {}), key: r[field_]}.items()]
    return mutate.merge_nodes(graph, spark.createDataFrame(stage, "label string, key string, property string, value string, seq bigint"))


def _write_edges(graph, m: re.Match, params: dict):  # noqa: ANN001, ANN202
    from canopy.operators import mutate

    g = m.groups()
    (_, a_label, _, a_field), (_, b_label, _, b_field) = g[2:6], g[6:10]
    spark = graph.nodes.sparkSession
    rows = [(a_label, _text(r.get(a_field)), m["type"].upper(), b_label, _text(r.get(b_field)), {k: _text(v) for k, v in ((r.get(m["props"]) or {}) if m["props"] else {}).items()}, n) for n, r in enumerate(params[m["batch"]])]
    stage = spark.createDataFrame(rows, "from_label string, from_key string, type string, to_label string, to_key string, properties map<string,string>, seq bigint")
    made = (mutate.merge_edges if m["verb"].upper() == "MERGE" else mutate.create_edges)(graph, stage)
    return made, mutate.with_endpoints(stage, graph.nodes).agg(F.count("*").alias(m["created"])) if m["created"] else None


def execute(graph, text: str, params: dict | None = None):  # noqa: ANN001, ANN201
    """The graph after a write, and the rows it returns, if any.

    Forms: UNWIND of a batch with MERGE or CREATE of nodes or edges (a count is that of matched rows), and MATCH ... [DETACH]
    DELETE. Without DETACH only relationships and nodes without any can be deleted.
    """
    from canopy.operators import mutate

    params = params or {}
    if m := _MERGE_NODE.match(text):
        return _write_nodes(graph, m, params), None
    if m := _MERGE_EDGE.match(text):
        return _write_edges(graph, m, params)
    clauses = Parser(text).clauses()
    if not clauses or clauses[-1][0] != "delete" or any(c[0] != "match" for c in clauses[:-1]):
        raise Unsupported("no write of a known form")
    planner = Planner(graph, params)
    for c in clauses[:-1]:
        planner._match(*c[1:])
    _, detach, names = clauses[-1]
    ids = rels = None
    for n in names:
        if n in planner.nodes:
            more = planner.table.select(F.col(f"`{n}.node_id`").alias("id"))
            ids = more if ids is None else ids.unionAll(more)
        elif n in planner.edges:
            more = planner.table.select(F.col(f"`{n}.rel_id`").alias("rel_id"))
            rels = more if rels is None else rels.unionAll(more)
        else:
            raise Unsupported(f"{n} is not bound")
    if rels is not None:
        graph = type(graph)(graph.nodes, graph.edges.join(rels.distinct(), "rel_id", "left_anti"))
    if ids is not None:
        ids = ids.where("id is not null").distinct()
        if not detach and graph.steps().join(ids, (F.col("src") == F.col("id")) | (F.col("dst") == F.col("id")), "left_semi").limit(1).count():
            raise Unsupported("DELETE of nodes that have relationships")
        graph = mutate.detach(graph, ids)
    return graph, None


def statement_in(answer: str) -> str:
    """The statement in a model's answer: the first fenced block, or the text without bold headings and backquotes.

    A leading word `cypher` goes, and the statement ends with a semicolon.
    """
    fenced = answer.split("```")
    if len(fenced) > 2:
        text = fenced[1]
    elif len(fenced) == 2:
        text = answer
    else:
        text = re.sub(r"\*\*.*?\*\*:?\s*", "", answer, flags=re.S).replace("`", "")
    text = re.sub(r"^cypher\b\s*", "", text.strip(), flags=re.I) if len(fenced) != 2 else text.strip()
    return text if text.endswith(";") else text + ";"
