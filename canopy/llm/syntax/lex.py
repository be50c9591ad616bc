"""Tokens of six languages as characters of kinds.

A token's kind depends on its text alone, so it is looked up in a table that is filled as texts are met. White space and
comments have no kind; a line end has one. What no language knows (an unclosed string or comment, a merge conflict marker,
a stray character) has the kind BAD.

In JavaScript and TypeScript the lexer has modes: the interpolations of a template literal are tokens between its parts, and
a slash behind a bracket begins a regular expression where the bracket is that of `if`, `while`, `for` or `with`. Python's
f-strings are one token, whose replacement fields are parsed when its kind is looked up.
"""

from __future__ import annotations

import re

from canopy.llm.syntax.peg import BAD, Grammar

CONFLICT = r"^(?:<{7}|={7}|>{7}|\|{7})(?![<=>|])[^\n]*"
_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)\w*"
_NAME = r"[^\W\d]\w*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
# A replacement field of an f-string may hold the string's own quotes.
_FIELD = r"\{(?!\{)(?:[^{}\n\"']|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\}"
_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*"
_BLANK = r"\n\s*|[^\S\n]+"
# What a regular expression may stand behind, with up to two blanks between; see `script_tokens` for closing brackets.
_OPERATORS = r"[=(,:\[!&|?{};+*%<>~^-]"
_WORDS = ("return", "typeof", "case", "do", "else", "in", "of", "instanceof", "void", "delete", "throw", "yield", "await")
_BEFORE_REGEX = "|".join([*(rf"(?<={_OPERATORS}{blanks})" for blanks in ("", r"\s", r"\s\s")), *(rf"(?<=[^\w$.]{w}{blank})" for w in _WORDS for blank in ("", r"\s"))])
_REGEX = r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"

PATTERNS = {
    "js": "|".join([
        CONFLICT, _BLANK, _C_COMMENT, _DQ, _SQ, r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$(?=\{))",
        rf"(?=/)(?:{_BEFORE_REGEX}){_REGEX}",
        _NUMBER, r"#?(?:[^\W\d]|\$)[\w$]*",
        r"\.\.\.|=>|\*\*=|===|!==|<<=|&&=|\|\|=|\?\?=|\?\.(?!\d)|\?\?|&&|\|\||==|!=|<=|\+\+|--|[-+*/%&|^]=|\*\*|<<|[-+*/%=<>!&|^~?:;,.(){}\[\]@]", r"[\s\S]",
    ]),
    "java": "|".join([
        CONFLICT, _BLANK, _C_COMMENT, r'"""[\s\S]*?"""', _DQ, r"'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[^\n]\d{0,2})'", _NUMBER, r"(?:[^\W\d]|\$)[\w$]*",
        r"\.\.\.|->|::|<<=|&&|\|\||==|!=|<=|\+\+|--|[-+*/%&|^]=|<<|[-+*/%=<>!&|^~?:;,.(){}\[\]@]", r"[\s\S]",
    ]),
    "go": "|".join([
        CONFLICT, _BLANK, _C_COMMENT, r"`[^`]*`", _DQ, r"'(?:[^'\\\n]|\\[^\n][\da-fA-F]{0,8})'", _NUMBER, _NAME,
        r"\.\.\.|<-|:=|&\^=|<<=|>>=|&&|\|\||==|!=|<=|>=|\+\+|--|[-+*/%&|^]=|&\^|<<|>>|[-+*/%=<>!&|^~:;,.(){}\[\]]", r"[\s\S]",
    ]),
    "lua": "|".join([
        CONFLICT, r"\A#![^\n]*", r"--\[(?P<c>=*)\[[\s\S]*?\](?P=c)\]|--\[\[[\s\S]*|--[^\n]*", _BLANK, r"\[(?P<s>=*)\[[\s\S]*?\](?P=s)\]", _DQ, _SQ, _NUMBER, _NAME,
        r"\.\.\.|\.\.|::|==|~=|<=|>=|<<|>>|//|[-+*/%^#&~|<>=(){}\[\];:,.]", r"[\s\S]",
    ]),
    "py": "|".join([
        CONFLICT, r"\n[ \t\f]*", r"\\\n[ \t]*|[ \t\f]+", r"#[^\n]*", r"(?i:r?fr?)(?:\"(?!\"\")(?:[^\"\\\n{]|\\.|\{\{|" + _FIELD + r")*\"|'(?!'')(?:[^'\\\n{]|\\.|\{\{|" + _FIELD + r")*')", r"(?i:[rbuft]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|" + _DQ + "|" + _SQ + ")", _NUMBER, _NAME,
        r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|[-+*/%&|^@]=|\*\*|//|<<|>>|[-+*/%=<>&|^~:;,.(){}\[\]@]", r"[\s\S]",
    ]),
}
PATTERNS["ts"] = PATTERNS["js"]
COMPILED = {k: re.compile(p, re.M) for k, p in PATTERNS.items()}
_REGEX_HERE = re.compile(r"(\s*)(" + _REGEX + ")")
_TEMPLATE_REST = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$(?=\{))?")
_MODES = re.compile(r"\)\s*/(?![/*])|\$\{")
_GOOD_NUMBER = {
    "js": re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?\Z"),
    "java": re.compile(r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?\Z"),
    "go": re.compile(r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)i?\Z"),
    "lua": re.compile(r"(?:0[xX][\da-fA-F.]+(?:[pP][+-]?\d+)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\Z"),
    "py": re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)\Z"),
}
_GOOD_NUMBER["ts"] = _GOOD_NUMBER["js"]


#: Names that grammars use for token classes and reduced blocks; as words of a source they are ordinary names.
INTERNAL = {"ID", "NUM", "STR", "FIRST", "PART", "LAST", "FUNCTION", "LAMBDA", "IF", "DO", "REPEAT", *"SILEWRTXFADCHMKilewrtxfdchk"}


def script_tokens(text: str) -> list[str]:
    """The tokens of JavaScript or TypeScript; a template is cut at its interpolations.

    A template's parts end before a `$` or with the closing backquote; a part behind an interpolation begins with the `}`
    that ends it.
    """
    tokens = COMPILED["js"]
    if not _MODES.search(text):
        return tokens.findall(text)
    out: list[str] = []
    depths: list[int] = []  # open braces in each interpolation
    brackets: list[bool] = []  # whether an open bracket is that of a head like `if (...)`
    last, at = "", 0
    while at < len(text):
        for m in tokens.finditer(text, at):
            t, at = m.group(), m.end()
            if t[0] in "(){}`" or "{" in t or "(" in t or t[-1] == "$":
                quoted = t[0] in "\"'`" or t[:2] in ("//", "/*")
                if t[0] == "`" and t[-1] == "$":
                    out.append(t)
                    depths.append(0)
                    last = t
                    continue
                bare = "" if quoted else t if len(t) == 1 else m[0][:1] if t[0] in "({" else ""
                if bare == "(":
                    brackets.append(last in ("if", "while", "for", "with", "await"))
                elif bare == ")":
                    head = brackets.pop() if brackets else False
                    if head and (found := _REGEX_HERE.match(text, at)):
                        out += [t, *([found[1]] if found[1] else []), found[2]]
                        last, at = "/", found.end()
                        break
                elif bare == "{" and depths:
                    depths[-1] += 1
                elif bare == "}" and depths:
                    depths[-1] -= 1
                    if depths[-1] == 0:
                        rest = _TEMPLATE_REST.match(text, at)
                        part = rest.group()
                        out.append("}" + part)
                        at = rest.end()
                        if part[-1:] != "$":
                            depths.pop()
                        last = "`"
                        break
            out.append(t)
            if not t.isspace() and not t.startswith(("//", "/*")):
                last = t
        else:
            break
    return out


_STRING = re.compile(r"([A-Za-z]{0,3})(\"\"\"|\'\'\'|\"|\')")


def fields_valid(t: str, kinds: Kinds) -> bool:
    """Whether every replacement field of a Python f-string holds an expression; other strings have none."""
    m = _STRING.match(t)
    if not m or "f" not in m[1].lower():
        return True
    return _fields(t[m.end() : -len(m[2])], kinds, "r" in m[1].lower())


def _fields(body: str, kinds: Kinds, raw: bool, spec: bool = False) -> bool:
    at = 0
    while at < len(body):
        c = body[at]
        if c == "\\" and not raw:
            at = body.find("}", at) + 1 if body.startswith("\\N{", at) else at + 2
            if not at:
                return False
        elif c in "{}" and body[at : at + 2] == 2 * c and not spec:
            at += 2
        elif c == "}":
            return False
        elif c == "{":
            end = _field(body, at + 1, kinds, raw)
            if end < 0:
                return False
            at = end
        else:
            at += 1
    return True


def _field(body: str, at: int, kinds: Kinds, raw: bool) -> int:
    """The place behind the field that begins at `at`; -1 if it isn't valid."""
    start, stack, stop = at, [], -1
    while at < len(body):
        c = body[at]
        if c in "\"'":
            quote = body[at : at + 3] if body[at : at + 3] in ('"""', "\'\'\'") else c
            at = body.find(quote, at + len(quote))
            if at < 0:
                return -1
            at += len(quote)
            continue
        if not stack and (c == "}" or c == ":" or (c == "!" and body[at + 1 : at + 2] != "=")):
            stop = at
            break
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack or "([{".index(stack.pop()) != ")]}".index(c):
                return -1
        at += 1
    if stop < 0:
        return -1
    inside = re.sub(r"(?<![=!<>])=\s*\Z", "", body[start:stop])
    shape = kinds.shape(inside.replace("\n", " "))
    if not shape or not kinds.grammar.matches("field", kinds.grammar.reduced(shape)):
        return -1
    if body[at] == "!":
        if not (m := re.compile(r"![ras](?=[:}])").match(body, at)):
            return -1
        at = m.end()
    if body[at] == ":":
        depth, at, begin = 0, at + 1, at + 1
        while at < len(body) and (depth or body[at] != "}"):
            depth += (body[at] == "{") - (body[at] == "}")
            at += 1
        if at >= len(body) or not _fields(body[begin:at], kinds, raw, True):
            return -1
    return at + 1


class Kinds(dict):
    """Kind of each token text of a language."""

    most = 300_000

    def __init__(self, language: str, grammar: Grammar) -> None:
        super().__init__()
        self.language, self.grammar = language, grammar
        self.tokens = COMPILED[language]
        self.find = script_tokens if language in ("js", "ts") else (lambda text: [m.group() for m in self.tokens.finditer(text)]) if self.tokens.groups else self.tokens.findall

    def __missing__(self, token: str) -> str:
        if len(self) > self.most:
            self.clear()
        kind = self[token] = self.kind(token)
        return kind

    def kind(self, t: str) -> str:
        language, char = self.language, self.grammar.char
        c = t[0]
        if c == "}" and len(t) > 1:
            return "}" + (char("PART") if t[-1] == "$" else char("LAST") if t[-1] == "`" else BAD)
        if c == "`" and t[-1] == "$" and language in ("js", "ts"):
            return char("FIRST")
        if c == "\n":
            if language == "py":
                return "\n" + chr(0x100 + len(t.lstrip("\n").expandtabs(8)))
            return "\n"
        if c.isspace() or c == "\ufeff" or (c == "\\" and t[1:2] == "\n"):
            return ""
        if len(t) >= 7 and t[:7] in ("<<<<<<<", "=======", ">>>>>>>", "|||||||"):
            return BAD
        if language == "py":
            if c == "#":
                return ""
        elif language == "lua":
            if t.startswith("--"):
                return BAD if t.startswith("--[[") and not t.endswith("]]") else "\n" if "\n" in t else ""
            if t.startswith("#!"):
                return ""
        elif t.startswith("//"):
            return ""
        elif t.startswith("/*"):
            return BAD if len(t) < 4 or not t.endswith("*/") else "\n" if "\n" in t else ""
        if language in ("js", "ts") and c == "/" and len(t) > 2:
            return char("STR")
        if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            return char("NUM") if _GOOD_NUMBER[language].match(t) else BAD
        if c in "\"'`" or (language == "lua" and t[:2] in ("[[", "[=")) or (language == "py" and t[-1] in "\"'"):
            return char("STR") if len(t) > 1 and (language != "py" or fields_valid(t, self)) else BAD
        if t in self.grammar.chars and t not in INTERNAL:
            return self.grammar.chars[t]
        if c.isalpha() or c in "_$#":
            if len(t) == 1 and c == "#":
                return char("#") if language == "lua" else BAD
            return char("ID")
        if t in "()[]{}":
            return t
        return BAD

    def shape(self, text: str) -> str:
        return "".join(map(self.__getitem__, self.find(text)))
