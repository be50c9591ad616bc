"""Functions and methods paired with their documentation.

Rows that weren't found, or have no text and no docstring, give nothing. What belongs to a file that does not parse (see
`unparsed`) is marked as broken: `pairs` has it, `documented_names` does not. A Module row gives the functions of its file, named by the row's `qualified_name` and the names around them; a
Function or Method row gives its own and those inside it. A null `qualified_name` gives nothing, a null project is a
project of its own, a null path is no file. Repeated rows give a pair once. Extra columns are dropped; an empty table gives
an empty result.

Declarations are parsed by generalised LL grammars over outlines, in which each token is one character and what stands in
brackets is one character too. Everything else is water: a declaration that doesn't parse is passed over and the next one is
tried; in a broken file it may also parse with a token left out. So the valid functions of broken files come out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.arrow import map_rows, words
from canopy.llm.syntax.check import language_of, plain, tokens_of, valid_tokens
from canopy.llm.syntax.gll import GLL
from canopy.llm.unparsed import says_unparsed
from canopy.session import cut, cut_counted, small

# Keywords by the character they have in outlines, and names of languages.
_KINDS = {
    "js": {"f": "function", "k": "class interface enum namespace module", "a": "async", "v": "const let var", "m": "export default public private protected static readonly abstract override declare get set accessor", "e": "extends implements", "x": "if for while do switch catch return new throw case else try finally typeof await yield delete void import in of instanceof with break continue super"},
    "java": {"k": "class interface enum record", "m": "public private protected static final abstract native synchronized default strictfp transient volatile sealed", "e": "extends implements throws permits", "x": "if for while do switch catch return new throw case else try finally import package instanceof assert break continue super this", "i": "int long double float boolean char byte short void var"},
    "go": {"f": "func", "k": "type", "v": "var const", "i": "map chan interface struct", "x": "if for switch select return go defer case default else import package range break continue goto fallthrough"},
    "lua": {"f": "function", "v": "local", "[": "do if repeat", "]": "end until", "x": "for while return then else elseif in break goto and or not"},
    "py": {"f": "def", "k": "class", "a": "async"},
}
_KINDS["ts"] = _KINDS["js"]
_NAMES = {"python": "py", "py": "py", "python3": "py", "javascript": "js", "js": "js", "ecmascript": "js", "node": "js", "typescript": "ts", "ts": "ts", "java": "java", "go": "go", "golang": "go", "lua": "lua"}

_TYPE = "type = part+\npart = 'i.|&BPOAsn?*-:' / '<' (type (',' type)*)? '>' / 'keyword'\n".replace(" / 'keyword'", "")
_SCRIPT = (
    """
head = notes (function / bound / method / field / class)
notes = ('@' 'i' ('.' 'i')* 'P'? / 'm')*
function = 'a'? 'f' '*'? @name 'i' generic? 'P' result? 'O'
bound = 'v' @name 'i' result? '=' value / ('ikm' '.')+ @name 'im' '=' value
field = @name 'im' result? '=' value / @name 'ims' ':' value
value = 'a'? 'f' '*'? 'i'? generic? 'P' result? 'O' / 'a'? generic? ('P' result? / 'i') 'A'
method = 'a'? '*'? @name 'imas' '?'? generic? 'P' result? 'O'
class = 'k' @class 'i' generic? ('e' type (',' type)*)* 'O'
generic = '<' inside* '>'
inside = 'i.|&BPOAsn?*-:,=e' / generic
result = ':' type
"""
    + _TYPE
)
_JAVA = (
    """
head = notes (method / bound / class)
notes = ('@' 'i' ('.' 'i')* 'P'? / 'm')*
method = generic? type @name 'i' 'P' 'B'* ('e' type (',' type)*)? 'O;' / generic? @name 'i' 'P' ('e' type (',' type)*)? 'O'
bound = type @name 'i' '=' ('P' / 'i') 'A'
class = 'k' @class 'i' generic? 'P'? ('e' type (',' type)*)* 'O'
generic = '<' inside* '>'
inside = 'i.&B?,@e' / generic
type = ('i.B?&' / generic / '@')+
"""
)
_GO = """
head = 'f' ('P' @receiver)? @name 'i' 'B'? 'P' result? 'O' / 'v' @name 'i' type? '=' 'f' 'P' result? 'O' / @name 'i' '=' 'f' 'P' result? 'O' / 'k' @class 'i'
result = 'P' / type
type = ('i.*BPOf')+
"""
_LUA = """
head = 'v'? 'f' path 'P' / 'v'? path '=' 'f' 'P'
path = ('i' '.')* @name 'i'
"""
_PYTHON = """
head = 'a'? 'f' @name 'i' 'B'? 'P' ('-' result+)? ':' / 'k' @class 'i' 'B'? 'P'? ':'
result = 'i.|BPOsn-'
"""


@cache
def _grammar(language: str) -> GLL:
    return GLL({"js": _SCRIPT, "ts": _SCRIPT, "java": _JAVA, "go": _GO, "lua": _LUA, "py": _PYTHON}[language])


class Outline(dict):
    """The outline character of each token text of a language."""

    def __init__(self, language: str) -> None:
        super().__init__()
        self.language = language
        self.words = {w: k for k, ws in _KINDS[language].items() for w in ws.split()}

    def __missing__(self, t: str) -> str:
        if len(self) > 300_000:
            self.clear()
        c = self[t] = self.kind(t)
        return c

    def kind(self, t: str) -> str:
        c, language = t[0], self.language
        if c == "\n":
            return "\n" if t.count("\n") == 1 else "\v"
        if c.isspace() or c == "\\":
            return " "
        if language == "py" and c == "#":
            return "c"
        if language == "lua":
            if t.startswith("--"):
                return "D" if t.startswith("---") else "c"
        elif language != "py" and t.startswith("/*"):
            return "D" if t.startswith("/**") and len(t) > 4 and language != "go" else "c"
        elif language != "py" and t.startswith("//"):
            return "D" if language == "go" else "c"
        if t in self.words:
            return self.words[t]
        if t in ("=>", "->") and language != "py":
            return "A"
        if t == ":=":
            return "="
        if c.isdigit() or (c == "." and t[1:2].isdigit()):
            return "n"
        if c == "}" and len(t) > 1:
            return c  # the end of an interpolation, with the next part of its template
        if language in ("js", "ts") and c == "/" and len(t) > 2:
            return "s"
        if c in "\"'`" or (len(t) > 1 and t[-1] in "\"'`") or (language == "lua" and t[:2] in ("[[", "[=")):
            return "s"
        if c.isalpha() or c in "_$#":
            return "i"
        if language == "lua" and t == ":":
            return "."
        if language == "lua" and t in "[]":
            return "B"
        if len(t) == 1 and t in "(){}[]<>=,.;:?*@|&-":
            return t
        return "-" if t == "->" else "~"


_OUTLINES = {k: Outline(k) for k in _KINDS}
_HEADS: dict[tuple, tuple | None] = {}
_PAIRS = {")": "(", "]": "[", "}": "{"}
_BRACKET = re.compile(r"[()\[\]{}]")
_GROUP = {"(": "P", "[": "B", "{": "O"}
_SOFT = " \n\vcD"


class File:
    """Tokens of a source text, its outline, and which brackets belong together."""

    def __init__(self, tokens: list[str], language: str, broken: bool = False) -> None:
        self.language, self.tokens, self.broken = language, tokens, broken
        self.s = "".join(map(_OUTLINES[language].__getitem__, self.tokens))
        self.close: dict[int, int] = {}
        self.up: dict[int, int] = {}
        stack: list[int] = []
        for m in _BRACKET.finditer(self.s):
            c, at = m.group(), m.start()
            if c in "([{":
                self.up[at] = stack[-1] if stack else -1
                stack.append(at)
            else:  # recovery: a closer that fits no opener is left out; openers inside a closed pair end with it
                k = next((k for k in range(len(stack) - 1, -1, -1) if self.s[stack[k]] == _PAIRS[c]), -1)
                if k >= 0 and (k == len(stack) - 1 or len(stack) - k <= 3):
                    for o in stack[k:]:
                        self.close[o] = at
                    del stack[k:]
        for o in stack:
            self.close[o] = len(self.s)
        self.open = {c: o for o, c in self.close.items()}
        self.openers = sorted(self.close)

    def slice(self, at: int) -> tuple[str, list[int]]:
        """Outline from `at` to the end of a head, without blanks and comments, groups as one character; and where each is from.

        A head ends with `;`, a brace group or the bracket around it; in Python and Go also with its line, in Python with
        a colon, in Lua with the first round brackets.
        """
        out, where, s, n = [], [], self.s, len(self.s)
        lined, last = self.language in ("py", "go"), {"py": ":", "lua": "P"}.get(self.language, ";")
        while at < n and not (out and out[-1] == last):
            c = s[at]
            if c in _SOFT:
                if lined and out and c in "\n\v":
                    break
                at += 1
                continue
            where.append(at)
            if c in _GROUP and not (c == "[" and self.language == "lua"):
                out.append(_GROUP[c])
                at = self.close[at] + 1
                if c == "{":
                    break
                continue
            if c in ")]}":
                where.pop()
                break
            out.append(c)
            at += 1
            if c == ";":
                break
        return "".join(out), where

    def head(self, at: int) -> tuple[dict[str, int], int] | None:
        """Marked tokens and last token of the declaration that begins at `at`."""
        text, where = self.slice(at)
        if self.language in ("js", "ts", "java") and text.endswith("O") and where[-1] < len(self.s) and self.language == "ts":
            more, rest = self.slice(self.close.get(where[-1], where[-1]) + 1)
            if re.match(r"[|&>,\[BO=A]", more):  # the braces were a type
                text, where = text + more, where + rest
        key = (self.language, self.broken, text)
        if key not in _HEADS:
            if len(_HEADS) > 300_000:
                _HEADS.clear()
            g = _grammar(self.language)
            _HEADS[key] = g.parse("head", text) or (g.parse("head", text, 1) if self.broken or "~" in text else None)
        found = _HEADS[key]
        if not found or not found[0]:
            return None
        end, marks = found
        return {k: where[v] if v < len(where) else where[-1] for k, v in marks.items()}, where[end - 1]

    def around(self, at: int) -> list[int]:
        """The opening braces around a token, outermost first."""
        i = bisect_right(self.openers, at) - 1
        out, o = [], self.openers[i] if i >= 0 else -1
        while o >= 0:
            if self.close[o] > at and self.s[o] == "{" and o < at:
                out.append(o)
            o = self.up[o]
        return out[::-1]

    def owner(self, brace: int) -> tuple[str, int, int] | None:
        """Kind, name token and last token of the declaration whose body the brace opens."""
        s, at, starts = self.s, brace - 1, []
        while at >= 0:
            c = s[at]
            if c in ")]":
                at = self.open.get(at, at) - 1
                continue
            if c in "\n\v":
                starts.append(at + 1)
            if c in ";{}":
                break
            if c == "(" or c == "[":
                break
            at -= 1
        for start in [*starts, at + 1]:
            found = self.head(start)
            if found:
                marks, end = found
                if end == brace or (self.s[end] == "A" and not self.s[end + 1 : brace].strip(_SOFT)):
                    for kind in ("class", "name"):
                        if kind in marks:
                            return kind, marks[kind], marks.get("receiver", -1)
        return None


def _receiver(f: File, after: int) -> str:
    """The type's name in the bracket group that ends before the name token `after`."""
    at = after - 1
    while at >= 0 and f.s[at] in _SOFT:
        at -= 1
    inside = [t for t, c in zip(f.tokens[f.open.get(at, at) : at], f.s[f.open.get(at, at) : at]) if c in "i[" ]
    if "[" in inside:
        inside = inside[: inside.index("[")]
    return inside[-1] if inside else ""


def _lines_above(f: File, at: int) -> str | None:
    """The run of documentation lines directly above token `at`."""
    out, s = [], f.s
    at -= 1
    while at >= 0 and s[at] in " v":
        at -= 1
    while at >= 1 and s[at] == "\n" and s[at - 1] == "D":
        before = at - 2
        while before >= 0 and s[before] == " ":
            before -= 1
        if before >= 0 and s[before] not in "\n\v":
            break  # behind code on its line
        out.append(f.tokens[at - 1])
        if before < 0 or s[before] == "\v":
            break
        at = before
    return "\n".join(reversed(out)) or None


def _braced(f: File, part: bool) -> Iterator[tuple[list[str], str | None, int, int]]:
    """Documented functions of JavaScript, TypeScript and Java: names, documentation, first and last token."""
    s = f.s
    owners: dict[int, tuple | None] = {}

    def names(at: int) -> tuple[list[str], str]:
        out, kind = [], ""
        for o in f.around(at):
            if o not in owners:
                owners[o] = f.owner(o)
            kind = "" if owners[o] is None else owners[o][0]
            if owners[o]:
                out.append(f.tokens[owners[o][1]].strip("\"'#"))
        return out, kind

    starts = [(m.start(), m.end()) for m in re.finditer("D *\n? *(?=[^\\sDc])", s)]
    if part and (first := re.search("[^\\sDc]", s)) and not any(b == first.start() for _, b in starts):
        starts.insert(0, (-1, first.start()))
    for doc, at in starts:
        found = f.head(at)
        if not found or "name" not in found[0]:
            continue
        marks, end = found
        name = marks["name"]
        chain, kind = names(doc if doc >= 0 else at)
        method = _is_method(f, at, name)
        if method and kind != "class" and not (part and not chain) and not _in_object(f, at):
            continue
        yield [*chain, f.tokens[name].strip("\"'#")], f.tokens[doc] if doc >= 0 else None, at, f.close.get(end, end)


def _is_method(f: File, at: int, name: int) -> bool:
    return not any(c in "fv=" for c in f.s[at:name]) and f.s[name + 1 : name + 12].lstrip(_SOFT)[:1] in "(<?"


def _in_object(f: File, at: int) -> bool:
    """Whether the braces around `at` are those of a value."""
    around = f.around(at)
    if not around or f.language == "java":
        return False
    before = f.s[: around[-1]].rstrip(_SOFT)[-1:]
    return before in tuple("=(,:[?") or before == "x"


def _worded(f: File) -> Iterator[tuple[list[str], str | None, int, int]]:
    """Functions of Go and Lua: names, documentation, first and last token."""
    s, lua = f.s, f.language == "lua"
    ends: dict[int, int] = {}
    if lua:
        stack: list[int] = []
        for m in re.finditer(r"[f\[\]]", s):
            c, at = m.group(), m.start()
            if c != "]":
                stack.append(at)
            elif stack:
                ends[stack.pop()] = at
    found_at: list[tuple[int, int, str]] = []
    for m in re.finditer("f", s):
        at = m.start()
        start = at
        while start > 0 and s[start - 1] not in "\n\v;{}":
            start -= 1
        while start < at and s[start] in _SOFT:
            start += 1
        found = f.head(start)
        if not found and start != at:
            continue
        if not found or "name" not in found[0] or not (start <= at <= found[1]):
            continue
        marks, end = found
        name = f.tokens[marks["name"]]
        stop = ends.get(at, len(s)) if lua else f.close.get(end, end)
        chain = [n for a, b, n in found_at if a < start and stop <= b]
        if not lua and "receiver" in marks:
            name = ".".join(x for x in (_receiver(f, marks["receiver"]), name) if x)
        found_at.append((start, stop, name))
        yield [*chain, name], _lines_above(f, start), start, stop


def _suite_end(f: File, colon: int, indent: int) -> int:
    """The last token of the suite behind a colon: up to the next line that is indented no more than its header."""
    s, at = f.s, colon + 1
    while at < len(s):
        if s[at] in "([{":
            at = f.close[at]
        elif s[at] in "\n\v":
            width = len(f.tokens[at].rpartition("\n")[2].expandtabs(8))
            after = s[at + 1 : at + 2]
            if after and after not in "\n\vc" and width <= indent:
                return at - 1
        at += 1
    return len(s) - 1


def _python(f: File) -> Iterator[tuple[list[str], str | None, int, int]]:
    s, tokens = f.s, f.tokens
    stack: list[tuple[int, str]] = []
    for m in re.finditer("[fk]", s):
        at = m.start()
        start = at
        while start > 0 and s[start - 1] in " a":
            start -= 1
        if start > 0 and s[start - 1] not in "\n\v":
            continue
        indent = len(tokens[start - 1].rpartition("\n")[2].expandtabs(8)) if start else 0
        if start == 0 and s[:1] == " ":
            indent = len(tokens[0].expandtabs(8))
        found = f.head(start)
        if not found:
            continue
        marks, colon = found
        while stack and stack[-1][0] >= indent:
            stack.pop()
        name = tokens[marks.get("name", marks.get("class"))]
        chain = [n for _, n in stack]
        stack.append((indent, name))
        if "name" not in marks:
            continue
        k = colon + 1
        while k < len(s) and s[k] in " \n\vc":
            k += 1
        doc = None
        if k < len(s) and s[k] == "s" and tokens[k].lstrip("rRuU")[:1] in "\"'" and (k + 1 >= len(s) or s[k + 1 : k + 6].lstrip(" c")[:1] in ("", "\n", "\v", ";")):
            doc = tokens[k]
        yield [*chain, name], doc, start, _suite_end(f, colon, indent)


def scan(tokens: list[str], language: str, part: bool = False, broken: bool = False) -> Iterator[tuple[list[str], str | None, str]]:
    """Names, raw documentation and code of the functions in a text's tokens.

    In languages with braces only the documented ones come out, and in a part of a file also its first.
    """
    f = File(tokens, language, broken)
    for n, d, a, b in _python(f) if language == "py" else _worded(f) if language in ("go", "lua") else _braced(f, part):
        yield n, d, "".join(f.tokens[a : b + 1])


# Documentation.
_ENTRY = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|return|returns|throws|exception|raise|raises|yield|yields|type|typeparam|template|tparam|treturn|see|since|deprecated|example|author|version|default|class|private|public|async|override|field|overload|generic|vararg|property|prop)\b|:(?:param|parameter|arg|argument|key|keyword|type|return|returns|rtype|raise|raises|except|exception|yield|yields|var|ivar)\b[^:\n]*:|(?:args|arguments|parameters|params|keyword args|keyword arguments|other parameters|returns?|yields?|raises|throws|inputs?|outputs?)\s*:\s*$|(?:args|arguments|parameters|params|returns?|raises|throws)\s*:\s|(?:parameters|returns?|raises|yields|arguments)\s*\n\s*[-=~]{3,})", re.I | re.M)
_MARKER = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|hack|wip)\b", re.I)
# What documentation says that is missing or still to come.
_ABSENT = re.compile(
    r"^\W*(?:(?:auto-?generated |automatic )?(?:stub|placeholder|skeleton)\W+)?(?:(?:the |this |a |an |any |proper |more |further |full |detailed )*(?:documentation|description|docs?|docstring|doc ?comment|comment|summary|details|text|explanation)s?\b.{0,40}?\b(?:pending|missing|to follow|to come|follows?|coming|later|soon|yet|needed|required|absent|todo|tbd|unavailable|will be|to be|goes here|here)\b.{0,60}"
    r"|(?:no|missing|without|lacks?|needs?|add|write|insert|put|provide|fill in|complete) (?:a |an |the |any |some |proper |further |more |full |better |real |useful |your )*(?:documentation|description|docs?|docstring|doc ?comment|comment|summary|details|explanation)s?\b.{0,70}"
    r"|(?:not|un|yet to be|to be|still to be|will be|has not been|is not) ?(?:yet )?(?:documented|described|written)\b.{0,60}|undocumented\b.{0,60}|(?:this|the) (?:function|method|class|helper|code|one|part|routine)s? (?:is|has|needs|still needs|lacks|remains|has yet|is yet|will be|is still|is not|has not been)\b.{0,30}\b(?:document|describ|documentation|description|undocumented|docs?)\w*\b.{0,50}"
    r"|(?:describe|document|explain) (?:this|the|me|what|it)\b.{0,20}\b(?:later|before|here|soon|when|once|asap|please)\b.{0,60}|(?:to be|will be) (?:documented|described|added|completed|filled in|written|done|announced)\b.{0,60}|(?:coming soon|work in progress|under construction|placeholder|lorem ipsum|see above|see below|same as above|as above|n/?a)\b.{0,30})\W*$",
    re.I | re.S,
)


def description(raw: str) -> str:
    """The text of a documentation comment or string, without its marks."""
    text = raw
    if m := re.match(r"[rRuU]?(\"\"\"|'''|\"|')", text):
        text = text[m.end() : -len(m[1])]
    elif text.startswith("/*"):
        text = re.sub(r"^[ \t]*\*+ ?", "", re.sub(r"^/\*+|\*+/$", "", text), flags=re.M)
    else:
        text = re.sub(r"^[ \t]*(?:-{2,}|/{2,}) ?", "", text, flags=re.M)
    return text.strip()


def summary(text: str) -> str:
    """What stands before the entries for parameters and results."""
    m = _ENTRY.search(text)
    return (text[: m.start()] if m else text).strip()


def is_trivial(text: str) -> bool:
    """Fewer than four words before the entries, a to-do mark at the start, or only a note that documentation is missing."""
    body = summary(text)
    return len(words(body)) < 4 or bool(_MARKER.match(body)) or bool(_ABSENT.match(" ".join(body.split())))


_SCHEMA = "project string, file_path string, broken boolean, qualified_name string"


def documented(df: DataFrame, with_text: bool = True) -> DataFrame:
    """(`project`, `file_path`, `broken`, `qualified_name`[, `documentation`, `code`]): pairs, and a row for each broken file.

    The row of a broken file has `broken` true and no name.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[tuple] = []
        for project, path, language, label, qn, text, doc, found, message in zip(*(c.to_pylist() for c in batch.columns)):
            module, known = label == "Module", language_of(path)
            path = path if path and path.strip() else None
            by_name = known or _NAMES.get((language or "").strip().lower())
            text = plain(text or "")
            tokens = tokens_of(text, by_name) if by_name and text.strip() else []
            broken = bool(module and path and ((known and tokens and not valid_tokens(tokens, known)) or says_unparsed(message)))
            if broken:
                out.append((project, path, True, None, None, None))
            if not found or not qn:
                continue
            seen: dict[str, tuple[str, str]] = {}
            if tokens:
                for names, raw, code in scan(tokens, by_name, not module, broken):
                    tail = names if module else names[1:]
                    if raw and not is_trivial(d := description(raw)):
                        seen.setdefault(".".join([qn, *tail]), (d, code))
            if not module and label in ("Function", "Method") and doc and not is_trivial(d := description(doc) if doc.lstrip()[:2] in ("/*", "//", "--") else doc.strip()):
                seen.setdefault(qn, (d, text))
            out += [(project, path, False, name, d, c) for name, (d, c) in seen.items()]
        if not out:
            return None
        columns = list(zip(*out))
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
        names = ["project", "file_path", "broken", "qualified_name", "documentation", "code"]
        n = 6 if with_text else 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds)], names[:n])

    rows = df.where("found or label = 'Module'").select("project", "file_path", "language", "label", "qualified_name", "source_code", "docstring", "found", "error_message")
    return map_rows(rows, run, _SCHEMA + ", documentation string, code string" * with_text, 128)


def _marked(rows: DataFrame) -> DataFrame:
    """The pairs, with `broken` true for those of a broken file."""
    rows = cut(rows)
    broken, n = cut_counted(rows.where("broken").select(F.col("project").alias("p"), F.col("file_path").alias("f")).distinct())
    return rows.where("not broken").drop("broken").join(small(broken, n), F.col("project").eqNullSafe(F.col("p")) & (F.col("file_path") == F.col("f")), "left").withColumn("broken", F.col("f").isNotNull()).drop("p", "f")


def pairs(df: DataFrame, share: float | None = None) -> DataFrame:
    """(`project`, `qualified_name`, `documentation`, `code`, `broken`), once each; of several the smallest documentation is taken.

    `broken` says that the function was only met in files that do not parse. With `share`, descriptions are dropped whose
    template (words without names and numbers) more than 1 + `share` times all functions of the corpus have in common;
    counts are of hashes of the templates.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        templates = [xxhash.xxh64_intdigest(" ".join(w for w in re.sub(r"`[^`]*`|\d+", " ", summary(d)).lower().split())) - (1 << 63) for d in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(templates, pa.int64())], [*batch.schema.names, "template"])

    met = _marked(documented(df))
    # One of a file that parses goes before one of a broken file.
    first = F.struct("broken", "documentation")
    once = met.groupBy("project", "qualified_name").agg(F.min(first).alias("first"), F.min_by("code", first).alias("code")).select("project", "qualified_name", "first.documentation", "code", "first.broken")
    if share is None:
        return once
    marked, n = cut_counted(map_rows(once, run, "project string, qualified_name string, documentation string, code string, broken boolean, template bigint"))
    common, m = cut_counted(marked.groupBy("template").count().where(F.col("count") > 1 + share * n).select("template"))
    return marked.join(small(common, m), "template", "left_anti").drop("template")


def documented_names(df: DataFrame) -> DataFrame:
    """Distinct (`project`, `qualified_name`) of the functions with documentation that is not trivial, of files that parse."""
    return _marked(documented(df, with_text=False)).where("not broken").select("project", "qualified_name").distinct()
