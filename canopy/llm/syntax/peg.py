"""Packrat parsing-expression grammars over token kinds.

A grammar is text, one rule a line: `name = alternatives`. Alternatives are separated by `/`, parts by blanks; parts may
be followed by `*`, `+` or `?`, preceded by `&` or `!`, and grouped with parentheses. `'x'` is a keyword or operator, `ID`,
`NUM` and `STR` are token classes, `<rule>` is a bracketed group whose inside matches `rule`, `NL` needs a line end (or the
end) here, `EOF` the end, `EMPTY` nothing. Line ends are skipped before any token.

Tokens are single characters. A bracketed group is reduced to one character too, which stands for the set of rules that its
inside matches in full. So the packrat memo is keyed by rule and text of kinds rather than by rule and position, and holds
for all files of a worker: each different statement shape is parsed once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

BAD = "\x01"  # no terminal matches it
END = "\x00"
_BRACKETS = {"(": ")", "[": "]", "{": "}"}
_PART = re.compile(r"\s*('(?:[^'\\]|\\.)*'|<\w+>|[A-Za-z_]\w*|[()/*+?&!])")

Parse = Callable[["Run", int], int]


class Run:
    """One parse: the kinds, the memo, and the furthest failure."""

    __slots__ = ("s", "n", "memo", "far")

    def __init__(self, s: str) -> None:
        self.s, self.n, self.memo, self.far = s + END, len(s), {}, 0


class Grammar:
    """Compiled grammar. `brackets` names the rules that are tried on the inside of each kind of bracket; `lines` those
    rules that hold for a text if they hold for each of its lines; `folded` those brackets in which line ends mean nothing."""

    most = 400_000

    def __init__(self, text: str, brackets: dict[str, list[str]], lines: set[str], words: set[str], indented: bool = False, folded: str = "([") -> None:
        self.brackets, self.lines, self.indented, self.folded = brackets, lines, indented, folded
        self.chars: dict[str, str] = {}
        self.classes: dict[tuple, str] = {}
        self.members: dict[str, set[str]] = {}
        self.groups: dict[str, dict[str, str]] = {b: {} for b in brackets}
        self.known: dict[str, dict[str, bool]] = {}
        self.rules: dict[str, Parse] = {}
        self.trees: dict[str, tuple] = {}
        for w in sorted(words):
            self.char(w)
        for line in text.strip().splitlines():
            if line.strip() and not line.lstrip().startswith("#"):
                name, _, body = line.partition(" = ")
                self.trees[name.strip()] = self._read(body)
        for i, (name, tree) in enumerate(self.trees.items()):
            self.rules[name] = self._memoised(i, self._compile(tree))
        for rules in brackets.values():
            for r in rules:
                self.members.setdefault(r, set())

    def char(self, token: str) -> str:
        """The character of a keyword or operator."""
        if len(token) == 1 and token in "()[]{}\n":
            return token
        if token not in self.chars:
            self.chars[token] = chr(0xE000 + len(self.chars))
        return self.chars[token]

    # Reading the grammar's text.
    def _read(self, body: str) -> tuple:
        parts, at = [], 0
        while m := _PART.match(body, at):
            parts.append(m[1])
            at = m.end()
        if body[at:].strip():
            raise ValueError(f"cannot read {body[at:]!r} in {body!r}")
        tree, rest = self._choice(parts)
        if rest:
            raise ValueError(f"too much in {body!r}")
        return tree

    def _choice(self, parts: list[str]) -> tuple[tuple, list[str]]:
        options = []
        while True:
            items = []
            while parts and parts[0] not in ("/", ")"):
                item, parts = self._item(parts)
                items.append(item)
            options.append(("seq", items))
            if not parts or parts[0] == ")":
                return ("or", options) if len(options) > 1 else options[0], parts
            parts = parts[1:]

    def _item(self, parts: list[str]) -> tuple[tuple, list[str]]:
        p, parts = parts[0], parts[1:]
        if p in "&!":
            inner, parts = self._item(parts)
            return (p, inner), parts
        if p == "(":
            item, parts = self._choice(parts)
            parts = parts[1:]
        elif p[0] == "'":
            item = ("token", p[1:-1])
        elif p[0] == "<":
            item = ("group", p[1:-1])
        else:
            item = ("name", p)
        while parts and parts[0] in ("*", "+", "?"):
            item, parts = (parts[0], item), parts[1:]
        return item, parts

    # Compiling it to functions.
    def _one_of(self, tree: tuple) -> set[str] | None:
        """The characters of an expression that matches single tokens only."""
        if tree[0] == "token":
            return {self.char(tree[1])}
        if tree[0] == "name" and tree[1] in ("ID", "NUM", "STR"):
            return {self.char(tree[1])}
        if tree[0] == "seq" and len(tree[1]) == 1:
            return self._one_of(tree[1][0])
        if tree[0] == "or":
            sets = [self._one_of(t) for t in tree[1]]
            return set().union(*sets) if all(s is not None for s in sets) else None
        return None

    @staticmethod
    def _terminal(chars: set[str]) -> Parse:
        def run(r: Run, at: int) -> int:
            c = r.s[at]
            if c in chars:
                return at + 1
            if c == "\n":
                while r.s[at] == "\n":
                    at += 1
                if r.s[at] in chars:
                    return at + 1
            if at > r.far:
                r.far = at
            return -1

        return run

    def _compile(self, tree: tuple) -> Parse:
        kind, body = tree
        if (chars := self._one_of(tree)) is not None:
            return self._terminal(chars)
        if kind == "group":
            return self._terminal(self.members.setdefault(body, set()))
        if kind == "name":
            if body == "EMPTY":
                return lambda r, at: at
            if body == "NL":
                return lambda r, at: at if r.s[at] in "\n\x00" else -1
            if body == "EOF":

                def end(r: Run, at: int) -> int:
                    while r.s[at] == "\n":
                        at += 1
                    if at == r.n:
                        return at
                    r.far = max(r.far, at)
                    return -1

                return end
            rules = self.rules
            if body not in self.trees:
                raise ValueError(f"no rule {body}")
            return lambda r, at: rules[body](r, at)
        if kind == "seq":
            items = [self._compile(t) for t in body]
            if len(items) == 1:
                return items[0]

            def sequence(r: Run, at: int) -> int:
                for item in items:
                    at = item(r, at)
                    if at < 0:
                        return -1
                return at

            return sequence
        if kind == "or":
            options = [self._compile(t) for t in body]

            def choice(r: Run, at: int) -> int:
                for option in options:
                    to = option(r, at)
                    if to >= 0:
                        return to
                return -1

            return choice
        inner = self._compile(body)
        if kind == "?":
            return lambda r, at: to if (to := inner(r, at)) >= 0 else at
        if kind in "*+":

            def repeat(r: Run, at: int) -> int:
                start = at
                while (to := inner(r, at)) > at:
                    at = to
                return at if kind == "*" or at > start else -1

            return repeat
        if kind == "&":
            return lambda r, at: at if inner(r, at) >= 0 else -1
        return lambda r, at: -1 if inner(r, at) >= 0 else at

    @staticmethod
    def _memoised(number: int, fn: Parse) -> Parse:
        def run(r: Run, at: int) -> int:
            key = (number, at)
            to = r.memo.get(key)
            if to is None:
                r.memo[key] = -1  # left recursion fails
                to = r.memo[key] = fn(r, at)
            return to

        return run

    # Matching.
    def parse(self, rule: str, s: str) -> tuple[bool, int]:
        """Whether `rule` consumes all of `s`, and the furthest failure."""
        r = Run(s)
        at = self.rules[rule](r, 0)
        if at >= 0:
            while r.s[at] == "\n":
                at += 1
            if at == r.n:
                return True, at
        return False, max(r.far, at)

    def matches(self, rule: str, s: str) -> bool:
        known = self.known.setdefault(rule, {})
        got = known.get(s)
        if got is None:
            if len(known) > self.most:
                known.clear()
            if BAD in s:
                got = False
            elif "\n" in s and rule in self.lines and all(self.matches(rule, x) for x in s.split("\n") if x):
                got = True
            else:
                got = self.parse(rule, s)[0]
            known[s] = got
        return got

    def group(self, bracket: str, inside: str) -> str:
        """The character of a bracketed group."""
        groups = self.groups[bracket]
        if self.indented or bracket in self.folded and "\n" in inside:
            inside = re.sub("\n.", "", inside) if self.indented else inside.replace("\n", "")
        c = groups.get(inside)
        if c is None:
            if len(groups) > self.most:
                groups.clear()
            found = frozenset(x for x in self.brackets[bracket] if self.matches(x, inside))
            c = groups[inside] = self.class_of(bracket, found)
        return c

    def class_of(self, kind: str, found: frozenset[str]) -> str:
        if not found:
            return BAD
        key = (kind, found)
        if key not in self.classes:
            c = self.classes[key] = chr(0xF0000 + len(self.classes))
            for x in found:
                self.members.setdefault(x, set()).add(c)
        return self.classes[key]

    def reduced(self, s: str) -> str:
        """`s` with every balanced bracket group as one character."""
        group = self.group

        def sub(m: re.Match) -> str:
            opener, inside, closer = m.groups()
            return group(opener, inside) if _BRACKETS[opener] == closer else BAD

        while True:
            s, n = _INNER.subn(sub, s)
            if not n:
                return s


_INNER = re.compile(r"([(\[{])([^()\[\]{}]*)([)\]}])")
UNBALANCED = re.compile(r"[()\[\]{}]")
