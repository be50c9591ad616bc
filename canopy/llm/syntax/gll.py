"""Generalised LL parsing with a graph-structured stack and error recovery.

Grammars are written as in `peg`, but choice is unordered and all derivations are followed; `@x` marks where the next
token is. Each rule and start position has one stack node, shared by all that call it; what a node has returned is kept and
replayed to later callers, so left recursion and ambiguity are no problem. With `skips`, a token that fits nowhere may be
left out at a cost; the cheapest, then shortest parse is the result.
"""

from __future__ import annotations

import re
from collections import defaultdict

_PART = re.compile(r"\s*('(?:[^'\\]|\\.)*'|@\w+|[A-Za-z_]\w*|[()/*+?])")


class GLL:
    def __init__(self, text: str) -> None:
        self.rules: dict[str, list[tuple]] = {}
        for line in text.strip().splitlines():
            if line.strip():
                name, _, body = line.partition(" = ")
                self._add(name.strip(), [m[1] for m in _PART.finditer(body)])

    def _add(self, name: str, parts: list[str]) -> list[str]:
        """Reads alternatives up to a closing bracket into rule `name`; returns what is left."""
        alternatives: list[list] = [[]]
        while parts and parts[0] != ")":
            p, parts = parts[0], parts[1:]
            if p == "/":
                alternatives.append([])
                continue
            if p == "(":
                inner = f"{name}.{len(self.rules)}"
                self.rules[inner] = []
                parts = self._add(inner, parts)[1:]
                symbol: tuple = ("rule", inner)
            elif p[0] == "'":
                symbol = ("token", frozenset(p[1:-1]))
            elif p[0] == "@":
                symbol = ("mark", p[1:])
            else:
                symbol = ("rule", p)
            while parts and parts[0] in ("*", "+", "?"):
                again = f"{name}.{len(self.rules)}"
                rule = ("rule", again)
                self.rules[again] = {"?": [(), (symbol,)], "*": [(), (symbol, rule)], "+": [(symbol,), (symbol, rule)]}[parts[0]]
                symbol, parts = rule, parts[1:]
            alternatives[-1].append(symbol)
        self.rules[name] = [tuple(a) for a in alternatives]
        return parts

    def parse(self, rule: str, s: str, skips: int = 0) -> tuple[int, dict[str, int]] | None:
        """End and marks of the cheapest, then shortest parse from the start of `s`; None if there is none."""
        root = (rule, 0)
        callers: dict[tuple, set] = defaultdict(set)  # the graph-structured stack: node to (where to go on, node, marks, cost)
        returned: dict[tuple, set] = defaultdict(set)
        todo, seen = [], set()

        def add(alternative: tuple, dot: int, node: tuple, at: int, marks: tuple, cost: int) -> None:
            d = (alternative, dot, node, at, marks, cost)
            if d not in seen:
                seen.add(d)
                todo.append(d)

        def call(name: str, at: int) -> None:
            for a in self.rules[name]:
                add(a, 0, (name, at), at, (), 0)

        call(rule, 0)
        while todo:
            alternative, dot, node, at, marks, cost = todo.pop()
            if dot == len(alternative):
                got = (at, marks, cost)
                if got not in returned[node]:
                    returned[node].add(got)
                    for a, d, n, m, c in callers[node]:
                        add(a, d, n, at, m + marks, c + cost)
                continue
            kind, value = alternative[dot]
            if kind == "mark":
                add(alternative, dot + 1, node, at, (*marks, (value, at)), cost)
            elif kind == "token":
                if at < len(s) and s[at] in value:
                    add(alternative, dot + 1, node, at + 1, marks, cost)
                elif cost < skips and at < len(s):
                    add(alternative, dot, node, at + 1, marks, cost + 1)
            else:
                below = (value, at)
                caller = (alternative, dot + 1, node, marks, cost)
                if caller not in callers[below]:
                    first = below not in callers or not callers[below]
                    callers[below].add(caller)
                    if first:
                        call(value, at)
                    for to, m, c in list(returned[below]):
                        add(alternative, dot + 1, node, to, marks + m, cost + c)
        if not returned[root]:
            return None
        end, marks, _ = min(returned[root], key=lambda x: (x[2], x[0], x[1]))
        return end, dict(marks)
