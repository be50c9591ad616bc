"""Whether a source text is valid in its language, and if not, where and why."""

from __future__ import annotations

import re
from functools import cache

from canopy.llm.syntax import grammars
from canopy.llm.syntax.lex import Kinds
from canopy.llm.syntax.peg import BAD, UNBALANCED, Grammar

# Languages by file extension.
EXTENSIONS = {"py": "py", "pyi": "py", "pyw": "py", "js": "js", "mjs": "js", "cjs": "js", "ts": "ts", "mts": "ts", "cts": "ts", "java": "java", "go": "go", "lua": "lua"}


@cache
def grammar_of(language: str) -> Grammar:
    return {"py": grammars.python, "js": lambda: grammars.script(False), "ts": lambda: grammars.script(True), "java": grammars.java, "go": grammars.go, "lua": grammars.lua}[language]()


@cache
def kinds_of(language: str) -> Kinds:
    g = grammar_of(language)
    for x in ("ID", "NUM", "STR"):
        g.char(x)
    return Kinds(language, g)


def language_of(path: str | None) -> str | None:
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    return EXTENSIONS.get(name.rsplit(".", 1)[1]) if "." in name else None


def plain(text: str) -> str:
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


# Python: logical lines become one character each, then indented blocks do.
_HEADS = {"if": ("h_if", "I"), "elif": ("h_elif", "L"), "else": ("h_else", "E"), "try": ("h_try", "T"), "except": ("h_except", "X"), "finally": ("h_finally", "F"), "while": ("h_while", "W"), "for": ("h_for", "R"), "def": ("h_def", "D"), "class": ("h_class", "C"), "with": ("h_with", "H"), "match": ("h_match", "M"), "case": ("h_case", "K"), "@": ("decorator", "A")}
_IN, _OUT = "\x02", "\x03"
_BLOCK = re.compile(f"{_IN}([^{_IN}{_OUT}]*){_OUT}")


@cache
def _python_heads() -> dict[str, tuple[str, str]]:
    g = grammar_of("py")
    return {g.char(k): v for k, v in _HEADS.items()}


def _python_line(g: Grammar, line: str, known: dict[str, str]) -> str:
    heads = _python_heads()
    head = heads.get(line[0])
    if head is None and line[0] == g.char("async") and len(line) > 1 and line[1] in (g.char("def"), g.char("for"), g.char("with")):
        head = heads[line[1]]
    out = BAD
    if BAD not in line:
        if head and g.matches(head[0], line):
            inline = head[1] not in "AM" and line[-1] != g.char(":")
            out = g.char(head[1].lower() if inline else head[1])
        elif g.matches("simple", line):
            out = g.char("S")
    if len(known) > 400_000:
        known.clear()
    known[line] = out
    return out


_LINES: dict[str, str] = {}


def _python_skeleton(shape: str, g: Grammar) -> tuple[str, list[int]]:
    """The blocks of a file as text of statement characters and indents; and which line each is from."""
    known, out, at, stack = _LINES, [], [], [0]
    for number, line in enumerate(shape.split("\n")):
        body = line[1:]
        if not body:
            continue
        indent = ord(line[0]) - 0x100
        if indent > stack[-1]:
            out.append(_IN)
            at.append(number)
            stack.append(indent)
        else:
            while indent < stack[-1]:
                stack.pop()
                out.append(_OUT)
                at.append(number)
            if indent != stack[-1]:
                out.append(BAD)
                at.append(number)
        c = known.get(body)
        out.append(c if c is not None else _python_line(g, body, known))
        at.append(number)
    out += [_OUT] * (len(stack) - 1)
    at += [at[-1] if at else 0] * (len(stack) - 1)
    return "".join(out), at


_BLOCKS: dict[str, str] = {}


def _python_block(m: re.Match) -> str:
    inside = m[1]
    c = _BLOCKS.get(inside)
    if c is None:
        g = grammar_of("py")
        if len(_BLOCKS) > 400_000:
            _BLOCKS.clear()
        c = _BLOCKS[inside] = g.class_of("block", frozenset(r for r in ("block", "casebody") if g.matches(r, inside)))
    return c


def tokens_of(text: str, language: str) -> list[str]:
    """The tokens of a plain text; Python's begin with a line end, which carries the first indent."""
    return kinds_of(language).find("\n" + text if language == "py" else text)


def _python_valid(tokens: list[str]) -> bool:
    g, kinds = grammar_of("py"), kinds_of("py")
    shape = g.reduced("".join(map(kinds.__getitem__, tokens)))
    if UNBALANCED.search(shape) or BAD in shape:
        return False
    s, _ = _python_skeleton(shape[1:], g)
    while True:
        if BAD in s:
            return False
        s, n = _BLOCK.subn(_python_block, s)
        if not n:
            return g.matches("module", s)


# Lua: blocks between keywords become one character, innermost first.
@cache
def _lua_patterns() -> tuple[re.Pattern, re.Pattern, dict[str, str]]:
    g = grammar_of("lua")
    k = {w: g.char(w) for w in ("function", "do", "if", "repeat", "end", "until", "then", "elseif", "else", "FUNCTION", "LAMBDA", "IF", "DO", "REPEAT")}
    opens, closes = "".join(k[w] for w in ("function", "do", "if", "repeat")), k["end"] + k["until"]
    return re.compile(f"([{opens}])([^{opens}{closes}]*)([{closes}])"), re.compile(f"([{k['then']}{k['elseif']}{k['else']}])"), k


_CHUNKS: dict[tuple[str, str, str], str] = {}


def _lua_chunk(opener: str, inside: str, closer: str) -> str:
    g = grammar_of("lua")
    _, parts, k = _lua_patterns()
    if (opener == k["repeat"]) != (closer == k["until"]):
        return BAD
    if opener == k["repeat"]:
        return k["REPEAT"] if g.matches("block", inside) else BAD
    if opener == k["do"]:
        return k["DO"] if g.matches("block", inside) else BAD
    if opener == k["function"]:
        found = re.match("[^\U000f0000-\U000fffff]*[\U000f0000-\U000fffff]", inside)
        if not found:
            return BAD
        head, body = found.group(), inside[found.end() :]
        if not g.matches("block", body):
            return BAD
        return k["LAMBDA"] if g.matches("lname", head) else k["FUNCTION"] if g.matches("fname", head) else BAD
    pieces = parts.split(inside)
    words, bodies = pieces[1::2], pieces[2::2]
    if not words or not g.matches("expr", pieces[0].replace("\n", "")):
        return BAD
    expect = k["then"]
    for w, body in zip(words, bodies):
        if expect == k["then"]:
            if w != expect or not g.matches("block", body):
                return BAD
            expect = ""
        elif w == k["elseif"] and expect == "":
            if not g.matches("expr", body.replace("\n", "")):
                return BAD
            expect = k["then"]
        elif w == k["else"] and expect == "":
            if not g.matches("block", body):
                return BAD
            expect = "none"
        else:
            return BAD
    return k["IF"] if expect != k["then"] else BAD


def _lua_reduced(s: str, g: Grammar) -> str:
    """Blocks and brackets hold each other (functions in calls, tables in blocks), so both are reduced in turn."""
    chunk, _, _ = _lua_patterns()

    def sub(m: re.Match) -> str:
        key = m.groups()
        c = _CHUNKS.get(key)
        if c is None:
            if len(_CHUNKS) > 400_000:
                _CHUNKS.clear()
            c = _CHUNKS[key] = BAD if UNBALANCED.search(key[1]) else _lua_chunk(*key)
        return c

    inner = re.compile(r"([(\[{])([^()\[\]{}" + _lua_openers() + r"]*)([)\]}])")
    while True:
        s, n = inner.subn(lambda m: g.group(m[1], m[2]) if {"(": ")", "[": "]", "{": "}"}[m[1]] == m[3] else BAD, s)
        s, k = _lua_clean().subn(sub, s)
        if not n and not k:
            return s


@cache
def _lua_openers() -> str:
    k = _lua_patterns()[2]
    return "".join(k[w] for w in ("function", "do", "if", "repeat", "end", "until"))


@cache
def _lua_clean() -> re.Pattern:
    k = _lua_patterns()[2]
    opens, closes = "".join(k[w] for w in ("function", "do", "if", "repeat")), k["end"] + k["until"]
    return re.compile(f"([{opens}])([^{opens}{closes}()\\[\\]{{}}]*)([{closes}])")


def _brace_valid(tokens: list[str], language: str) -> bool:
    g, kinds = grammar_of(language), kinds_of(language)
    s = "".join(map(kinds.__getitem__, tokens))
    if BAD in s:
        return False
    s = _lua_reduced(s, g) if language == "lua" else g.reduced(s)
    return not UNBALANCED.search(s) and BAD not in s and g.matches("module", s)


def valid(text: str, language: str) -> bool:
    """Whether all of `text` is a file of `language`; an empty or blank one is."""
    text = plain(text)
    return not text.strip() or valid_tokens(tokens_of(text, language), language)


def valid_tokens(tokens: list[str], language: str) -> bool:
    """`valid` for the tokens of a plain text that is not blank."""
    return _python_valid(tokens) if language == "py" else _brace_valid(tokens, language)


# Where and why: only for texts that are not valid, token by token.
_CLOSERS = {")": "(", "]": "[", "}": "{"}
_CAUSES = ((r"<{7}|={7}|>{7}|\|{7}", "merge conflict"), (r"[\"'`]", "unclosed string"), (r"/\*|--\[", "unclosed comment"), (r"\d", "malformed number"))


def _tokens(text: str, language: str) -> list[tuple[str, int, str]]:
    """Kind characters with the offset and text of their tokens."""
    kinds, out, at = kinds_of(language), [], 0
    for t in kinds.find(text):
        out += [(c, at, t) for c in kinds[t]]
        at += len(t)
    return out


def diagnose(text: str, language: str) -> tuple[int, int, str] | None:
    """Line and column of the furthest failure and its cause, both from 1; None for a valid text.

    A merge conflict marker comes first, then what the lexer rejects, then the innermost bracket group or line that no
    rule consumes, with the furthest token its parses reached, then brackets and blocks that don't pair up.
    """
    if valid(text, language):
        return None
    text, g = plain(text), grammar_of(language)
    shift = int(language == "py")
    tokens = _tokens("\n" * shift + text, language)

    def place(offset: int, cause: str) -> tuple[int, int, str]:
        before = text[: max(0, offset - shift)]
        return before.count("\n") + 1, len(before) - (before.rfind("\n") + 1) + 1, cause

    wrong = [(o, t) for c, o, t in tokens if c == BAD]
    if wrong:
        marked = [(o, t) for o, t in wrong if re.match(_CAUSES[0][0], t)]
        offset, t = (marked or wrong)[0]
        return place(offset, next((cause for p, cause in _CAUSES if re.match(p, t)), "stray character"))
    stack: list[tuple[str, int, list]] = [("", 0, [])]
    for c, offset, _ in tokens:
        if c in "([{":
            stack.append((c, offset, []))
        elif c in _CLOSERS:
            opener, opened, inside = stack.pop()
            if opener != _CLOSERS[c]:
                return place(offset, "unmatched bracket")
            s = "".join(k for k, _ in inside)
            folded = re.sub("\n.", "", s) if g.indented else s.replace("\n", "") if opener in g.folded else s
            made = g.group(opener, s) if language != "lua" else g.class_of("any", frozenset(g.brackets[opener]))
            if made == BAD:
                far = max(g.parse(r, folded)[1] for r in g.brackets[opener])
                kept = [o for k, o in inside if folded is s or k in folded] or [offset]
                return place(kept[far] if far < len(kept) else offset, "unexpected token")
            stack[-1][2].append((made, opened))
        else:
            stack[-1][2].append((c, offset))
    if len(stack) > 1:
        return place(stack[-1][1], "unclosed bracket")
    line: list[tuple[str, int]] = []
    for c, offset in [*stack[0][2], ("\n", len(text) + shift)]:
        if c != "\n":
            line.append((c, offset))
            continue
        if language == "py":
            body = "".join(k for k, _ in line[2:])  # behind the line end and its indent
            if body and _python_line(g, body, {}) == BAD:
                head = _python_heads().get(body[0])
                far = g.parse(head[0] if head else "simple", body)[1]
                return place(line[2 + min(far, len(body) - 1)][1], "unexpected token")
        line = [(c, offset)] if language == "py" else []
    if language == "py":
        s, at = _python_skeleton(g.reduced(kinds_of("py").shape("\n" + text))[1:], g)
        far, numbers = g.parse("module", s)[1], at
        bad = s.find(BAD)
        spot = bad if bad >= 0 else min(far, len(numbers) - 1)
        logical = [o for c, o in stack[0][2] if c == "\n"]
        return place(logical[numbers[spot]] + 1 if numbers and numbers[spot] < len(logical) else len(text), "wrong indentation" if bad >= 0 else "unexpected block")
    if language == "lua":
        opened = []
        names = {g.char(w): w for w in ("function", "do", "if", "repeat", "end", "until")}
        for c, offset, _ in tokens:
            w = names.get(c)
            if w in ("end", "until"):
                if not opened or (opened[-1][0] == "repeat") != (w == "until"):
                    return place(offset, "unmatched block end")
                opened.pop()
            elif w:
                opened.append((w, offset))
        if opened:
            return place(opened[-1][1], "unclosed block")
    s = "".join(k for k, _ in stack[0][2])
    if language == "lua":
        return place(tokens[0][1] if tokens else 0, "unexpected token")
    far = g.parse("module", s)[1]
    return place(stack[0][2][far][1] if far < len(stack[0][2]) else len(text), "unexpected token")
