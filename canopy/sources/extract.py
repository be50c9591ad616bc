"""Facts from source files: definitions, imports, base classes, variable types and calls.

Every file is parsed for itself in one pass over Arrow batches and gives rows of one table; what needs other files is
left to joins in `operators.resolve`. Python goes through the standard library's parser. For other languages declarations,
imports, calls and the types that variables are bound or declared with are found by patterns and braces.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.sources.languages import language_of

SCHEMA = "project string, path string, module string, fact string, name string, qualified_name string, label string, parent string, parent_label string, target string, ord int, start_line int, end_line int, docstring string, decorators array<string>, is_exported boolean"


def module_of(project: str, path: str) -> str:
    parts = path.split("/")
    last = parts.pop()
    if last not in ("__init__.py", "mod.rs"):
        parts.append(last.rsplit(".", 1)[0] if "." in last[1:] else last)
    return ".".join([project, *parts])


class _Facts(list):
    def __init__(self, project: str, path: str) -> None:
        self.base = {"project": project, "path": path, "module": module_of(project, path)}
        self.module = self.base["module"]

    def put(self, fact: str, **more: object) -> None:
        self.append({**self.base, "fact": fact, **more})


def _dotted(e: ast.AST) -> str | None:
    """A name such as `a.b.c`, with calls inside as `a.b().c`."""
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        inner = _dotted(e.value)
        return f"{inner}.{e.attr}" if inner else None
    if isinstance(e, ast.Call):
        inner = _dotted(e.func)
        return f"{inner}()" if inner else None
    return None


def _python_import(out: _Facts, node: ast.Import | ast.ImportFrom, ord_: int) -> int:
    """Local names and full names. Whether a name is the project's own is decided later, by join."""
    if isinstance(node, ast.Import):
        for a in node.names:
            out.put("import", name=a.asname or a.name.split(".")[0], target=a.name, ord=ord_)
            ord_ += 1
        return ord_
    if node.level:
        inside = out.module.split(".")[1:]
        package = out.base["path"].endswith("__init__.py")
        keep = len(inside) - node.level + (1 if package else 0)
        base = ".".join([out.module.split(".")[0], *inside[: max(0, keep)], *([node.module] if node.module else [])])
    else:
        base = node.module or ""
    for a in node.names:
        if a.name == "*":
            out.put("import", name=f"*{base}", target=base, ord=ord_)
        else:
            out.put("import", name=a.asname or a.name, target=f"{base}.{a.name}", ord=ord_)
        ord_ += 1
    return ord_


def _python_types(out: _Facts, owner: str, body: list[ast.stmt], cls: str | None) -> None:
    """Types of variables from `x = C()`, `x: C` and of attributes from `self.x = C()`."""
    for stmt in body:
        for n in ast.walk(stmt):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n is not stmt:
                continue
            pairs: list[tuple[ast.AST, ast.AST | None]] = []
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call):
                pairs = [(t, n.value.func) for t in n.targets]
            elif isinstance(n, ast.AnnAssign):
                pairs = [(n.target, n.annotation)]
            for target, value in pairs:
                name, kind = _dotted(target), _dotted(value) if value else None
                if name and kind and "(" not in kind:
                    scope = cls if cls and name.startswith("self.") else owner
                    out.put("variable", parent=scope, name=name, target=kind, start_line=n.lineno)


def _python(out: _Facts, text: str) -> None:
    tree = ast.parse(text)
    ord_ = 0
    for n in ast.walk(tree):
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            ord_ = _python_import(out, n, ord_)

    def visit(body: list[ast.stmt], scope: str, label: str, cls: str | None, callers: list[str]) -> None:
        for stmt in body:
            walk(stmt, scope, label, cls, callers)

    def calls(node: ast.AST, cls: str | None, callers: list[str]) -> None:
        if isinstance(node, ast.Call) and (name := _dotted(node.func)):
            for caller in callers:
                out.put("call", parent=caller, name=name, target=cls, start_line=node.lineno)
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            calls(child, cls, callers)

    def walk(node: ast.AST, scope: str, label: str, cls: str | None, callers: list[str]) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            qn = f"{scope}.{node.name}"
            is_class = isinstance(node, ast.ClassDef)
            kind = "Class" if is_class else "Method" if label == "Class" else "Function"
            marks = ["@" + (ast.get_source_segment(text, d) or ast.unparse(d)) for d in node.decorator_list]
            out.put("definition", name=node.name, qualified_name=qn, label=kind, parent=scope, parent_label=label, start_line=node.lineno, end_line=node.end_lineno, docstring=(ast.get_docstring(node, clean=False) or "").strip("'\" \n") or None, decorators=marks, is_exported=False)
            for d in node.decorator_list:
                calls(d, cls, callers)
            if is_class:
                for k, b in enumerate(node.bases):
                    if base := _dotted(b):
                        out.put("inherits", qualified_name=qn, name=base, ord=k)
                visit(node.body, qn, "Class", qn, callers)
            else:
                args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
                for a in args:
                    kind_name = _dotted(a.annotation) if a.annotation else None
                    if a.arg not in ("self", "cls"):
                        out.put("parameter", parent=qn, name=a.arg, target=kind_name)
                    if kind_name:
                        out.put("variable", parent=qn, name=a.arg, target=kind_name, start_line=node.lineno)
                _python_types(out, qn, node.body, cls)
                visit(node.body, qn, kind, cls, [*callers, qn])
            return
        calls(node, cls, callers)
        for child in ast.iter_child_nodes(node):
            nested(child, scope, label, cls, callers)

    def nested(node: ast.AST, scope: str, label: str, cls: str | None, callers: list[str]) -> None:
        """Definitions inside compound statements; their calls have been counted already."""
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            walk(node, scope, label, cls, callers)
        else:
            for child in ast.iter_child_nodes(node):
                nested(child, scope, label, cls, callers)

    _python_types(out, out.module, [s for s in tree.body if not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], None)
    visit(tree.body, out.module, "Module", None, [out.module])


_CLASSES = {"class": "Class", "struct": "Class", "record": "Class", "object": "Class", "interface": "Interface", "trait": "Interface", "enum": "Enum", "union": "Union", "type": "Type", "impl": "impl"}
_NAME = r"[A-Za-z_$][\w$]*"
_SKIP = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/|--\[\[.*?\]\]|--[^\n]*", re.S)
_DECLARED = {
    "javascript": [rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface|enum)\s+({_NAME})", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?(function)\s*\*?\s*({_NAME})\s*\(", rf"(?:export\s+)?(?:const|let|var)\s+({_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|{_NAME}\s*=>)"],
    "java": [rf"\b(class|interface|enum|record)\s+({_NAME})"],
    "go": [rf"^(func)\s+(?:\(\s*\w+\s+\*?({_NAME})[^)]*\)\s*)?({_NAME})\s*[\[(]", rf"^(type)\s+({_NAME})\s+(?:struct|interface)"],
    "lua": [rf"(?:local\s+)?(function)\s+((?:{_NAME}[.:])*{_NAME})\s*\(", rf"((?:{_NAME}[.:])*{_NAME})\s*=\s*function\s*\("],
    "rust": [rf"\b(struct|enum|trait|union|type)\s+({_NAME})", rf"\b(fn)\s+({_NAME})", rf"\b(impl)(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?({_NAME})"],
    "cpp": [rf"\b(class|struct|enum|union)\s+(?:class\s+)?({_NAME})\s*(?:final\s*)?[:{{]", rf"^[\w:<>,&*\s~]+?\s[&*]*((?:{_NAME}::)*~?{_NAME})\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|final|\s)*\{{"],
    "php": [rf"\b(class|interface|trait|enum)\s+({_NAME})", rf"\b(function)\s+&?({_NAME})\s*\("],
    "c_sharp": [rf"\b(class|interface|enum|struct|record)\s+({_NAME})"],
    "scala": [rf"\b(class|object|trait)\s+({_NAME})", rf"\b(def)\s+({_NAME})"],
}
_DECLARED["typescript"] = [*_DECLARED["javascript"], rf"(?:export\s+)?(type)\s+({_NAME})\s*(?:<[^=\n]*>)?\s*="]
_DECLARED["c"] = _DECLARED["cpp"]
_METHOD = re.compile(rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|async|override|readonly|synchronized|virtual|internal|get|set|default)\s+)*(?:[\w$<>\[\],.?]+\s+)?\*?#?({_NAME})\s*(?:<[^>()]*>)?\s*\(([^;{{}}]*)\)\s*(?::\s*[^{{;=]+)?(?:throws\s+[\w., ]+)?\{{", re.M)
_IMPORTS = {
    "javascript": r"import\s+(?:type\s+)?(?P<what>[^'\";]+?)\s+from\s+['\"](?P<from>[^'\"]+)['\"]|(?:const|let|var)\s+(?P<req>[\w{},\s:$]+?)\s*=\s*require\(\s*['\"](?P<from2>[^'\"]+)['\"]\s*\)",
    "java": r"import\s+(?:static\s+)?(?P<from>[\w.]+(?:\.\*)?)\s*;",
    "go": r"^\s*(?:import\s+)?(?P<what>[\w.]+\s+)?\"(?P<from>[^\"\s]+)\"\s*$",
    "lua": r"(?:local\s+(?P<what>\w+)\s*=\s*)?require\s*\(?\s*['\"](?P<from>[^'\"]+)['\"]",
    "rust": r"use\s+(?P<from>[\w:]+(?:::\{[^}]*\}|::\*)?)(?:\s+as\s+(?P<what>\w+))?\s*;",
    "cpp": r"#include\s*(?P<from>[<\"][^>\"]+[>\"])",
    "php": r"use\s+(?P<from>[\w\\]+)(?:\s+as\s+(?P<what>\w+))?\s*;",
    "c_sharp": r"using\s+(?:static\s+)?(?P<from>[\w.]+)\s*;",
    "scala": r"import\s+(?P<from>[\w.]+(?:\.\{[^}]*\}|\._)?)",
}
_IMPORTS["typescript"], _IMPORTS["c"] = _IMPORTS["javascript"], _IMPORTS["cpp"]
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "else", "do", "try", "new", "synchronized", "using", "lock", "foreach", "match"}


def _import_rows(language: str, module: str, m: re.Match) -> Iterator[tuple[str, str]]:
    """(local, full) of an import statement."""
    g = m.groupdict()
    source = g.get("from") or g.get("from2") or ""
    what = (g.get("what") or g.get("req") or "").strip()
    if language in ("javascript", "typescript"):
        if source.startswith("."):
            parts = module.split(".")[:-1]
            for step in source.split("/"):
                if step == "..":
                    parts = parts[:-1]
                elif step not in (".", ""):
                    parts.append(re.sub(r"\.(?:js|ts|jsx|tsx)$", "", step))
            source = ".".join(parts)
        else:
            source = source.replace("/", ".")
        head, _, braces = what.partition("{")
        for x in filter(None, (y.strip() for y in head.split(","))):
            yield (x.split(" as ")[-1].strip(), source) if x.startswith("*") else (x, source if g.get("req") else f"{source}.default")
        for x in filter(None, (y.strip() for y in braces.rstrip("} ,").split(","))):
            original, _, local = x.replace(":", " as ").partition(" as ")
            yield (local or original).strip(), f"{source}.{original.strip()}"
    elif language == "go":
        yield what or source.rsplit("/", 1)[-1], source
    elif language == "lua":
        yield what or source.rsplit(".", 1)[-1], source
    elif language in ("cpp", "c"):
        inner = source[1:-1]
        name = re.sub(r"\.\w+$", "", inner.rsplit("/", 1)[-1])
        yield name, f"std.{inner}" if source[0] == "<" else ".".join([module.split(".")[0], *re.sub(r"\.\w+$", "", inner).split("/")])
    else:
        for sep in ("::", "\\", "."):
            if sep in source:
                base, _, last = source.rpartition(sep)
                if last.startswith("{"):
                    for x in filter(None, (y.strip() for y in last.strip("{}").split(","))):
                        original, _, local = x.partition(" as ")
                        yield local or original, f"{base}{sep}{original}".replace("\\", ".")
                elif last in ("*", "_"):
                    yield f"*{base}".replace("\\", "."), base.replace("\\", ".")
                else:
                    yield what or last, source.replace("\\", ".")
                return
        yield what or source, source


def _braced(out: _Facts, text: str, language: str) -> None:
    blank = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "/-" else m[0][0] + " " * (len(m[0]) - 2) + m[0][-1] if "\n" not in m[0] else re.sub(r"[^\n]", " ", m[0]), text)
    ord_ = 0
    for m in re.finditer(_IMPORTS[language], text, re.M):
        for local, full in _import_rows(language, out.module, m):
            out.put("import", name=local, target=full, ord=ord_)
            ord_ += 1
    found: list[list] = []
    for pattern in _DECLARED[language]:
        for m in re.finditer(pattern, blank, re.M):
            groups = [g for g in m.groups() if g]
            word = groups[0] if groups[0] in _CLASSES or groups[0] in ("function", "func", "fn", "def") else ""
            name = groups[-1]
            label = _CLASSES.get(word, "Function")
            owner = m[2] if language == "go" and word == "func" and m[2] else None
            found.append([m.start(), _end(blank, m.end() - 1, language), label, name, owner])
    spans = [(a, b) for a, b, label, *_ in found if label in ("Class", "Interface", "Enum")]
    taken = {a for a, *_ in found}
    if language not in ("go", "lua", "rust", "c"):
        for m in _METHOD.finditer(blank):
            at = m.start(1)
            if m[1] in _KEYWORDS or not any(a < at < b for a, b in spans) or any(abs(at - t) < 12 for t in taken if blank[t : t + 12].startswith(("function", "class"))):
                continue
            found.append([m.start(), _end(blank, m.end() - 1, language), "Function", m[1], None])
    found.sort(key=lambda x: (x[0], -x[1]))
    stack: list[tuple[int, str, str]] = []
    defined: list[tuple[int, int, str, str, int]] = []
    for start, end, label, name, owner in found:
        while stack and stack[-1][0] <= start:
            stack.pop()
        scope, kind = (stack[-1][1], stack[-1][2]) if stack else (out.module, "Module")
        if label == "impl":
            stack.append((end, f"{out.module}.{name}", "Class"))
            continue
        if owner:
            scope, kind = f"{out.module}.{owner}", "Class"
        parts = re.split(r"[.:]+", name) if language in ("lua", "cpp", "c") else [name]
        qn = ".".join([scope, *[p for p in parts if p]])
        if label == "Function" and (kind in ("Class", "Interface", "Enum") or (language == "cpp" and len(parts) > 1)):
            label = "Method"
        opener = blank.find("(", blank.find(parts[-1], start))
        defined.append((start, end, qn, label, opener if label in ("Function", "Method") else -1))
        if owner and (m := re.match(rf"\s*func\s*\(\s*({_NAME})\s", blank[start:])):
            out.put("variable", parent=qn, name=m[1], target=owner, start_line=text.count("\n", 0, start) + 1)
        line = text.count("\n", 0, start + len(text[start:]) - len(text[start:].lstrip())) + 1
        out.put("definition", name=parts[-1], qualified_name=qn, label=label, parent=scope, parent_label=kind, start_line=line, end_line=text.count("\n", 0, end) + 1, decorators=[], is_exported=bool(re.match(r"\s*export\b", blank[start : start + 40])))
        if label in ("Class", "Interface"):
            head = blank[start : blank.find("{", start) if "{" in blank[start:] else start + 200]
            bases = re.findall(r"(?:extends|implements|:)\s+([\w$.<>, ]+?)(?=\s*(?:extends|implements|$|\{))", head)
            for k, b in enumerate(x.strip() for part in bases for x in re.sub(r"<[^<>]*>", "", part).split(",")):
                if b:
                    out.put("inherits", qualified_name=qn, name=re.sub(r"^(?:public|private|protected|virtual)\s+", "", b), ord=k)
        stack.append((end, qn, label))
    _uses(out, blank, language, defined)


_CALL = re.compile(rf"(?<![\w$.:>])((?:{_NAME}\s*(?:\?\.|\.|::|->|:))*{_NAME})\s*(?:<[\w$<>, .\[\]]*>\s*)?\(")
_NO_CALL = _KEYWORDS | {"func", "fn", "def", "elseif", "and", "or", "not", "in", "of", "typeof", "await", "yield", "throw", "super", "defer", "go", "select", "range", "require", "sizeof", "assert", "this", "self"}
#: Groups: variable, type. What a variable is bound or declared with, by language.
_TYPED = {
    "javascript": [rf"(?:const|let|var)\s+({_NAME})\s*=\s*new\s+((?:{_NAME}\.)*{_NAME})", rf"(this\.{_NAME})\s*=\s*new\s+((?:{_NAME}\.)*{_NAME})"],
    "java": [rf"\b({_NAME})\s+({_NAME})\s*=\s*new\s+{_NAME}", rf"\b([A-Z][\w.]*)(?:<[^;(){{}}=]*>)?\s+({_NAME})\s*(?=[=;,)])"],
    "go": [rf"\b({_NAME})\s*:=\s*&?((?:{_NAME}\.)?[A-Z]\w*)\{{", rf"\bvar\s+({_NAME})\s+\*?((?:{_NAME}\.)?[A-Z]\w*)", rf"[(,]\s*({_NAME})\s+\*?((?:{_NAME}\.)?[A-Z]\w*)\s*(?=[,)])"],
    "lua": [rf"(?:local\s+)?({_NAME})\s*=\s*((?:{_NAME}\.)*{_NAME})[.:]new\s*\("],
}
_TYPED["typescript"] = [*_TYPED["javascript"], rf"(?:const|let|var)\s+({_NAME})\s*:\s*((?:{_NAME}\.)*[A-Z]\w*)", rf"[(,]\s*(?:(?:public|private|protected|readonly)\s+)*({_NAME})\??\s*:\s*((?:{_NAME}\.)*[A-Z]\w*)", rf"^\s*(?:(?:public|private|protected|readonly|static)\s+)*({_NAME})[?!]?\s*:\s*((?:{_NAME}\.)*[A-Z]\w*)\s*[;=]"]
_TYPED["c_sharp"] = _TYPED["scala"] = _TYPED["java"]


def _uses(out: _Facts, text: str, language: str, spans: list[tuple[int, int, str, str, int]]) -> None:
    """Calls and the types of variables in a text without strings and comments.

    `spans` are the definitions in order of their start: start, end, name, label, and where the name's list of parameters
    begins. A call belongs to every function around it and to the module; a variable to the innermost function, or to the
    class if it is a field.
    """
    heads = {s[4] for s in spans}
    starts, up, open_ = [s[0] for s in spans], [], []
    for i, s in enumerate(spans):
        while open_ and spans[open_[-1]][1] <= s[0]:
            open_.pop()
        up.append(open_[-1] if open_ else -1)
        open_.append(i)
    breaks = [m.start() for m in re.finditer("\n", text)]

    def around(at: int) -> list[tuple[int, int, str, str, int]]:
        """The definitions around a place, outermost first."""
        i, holders = bisect_right(starts, at) - 1, []
        while i >= 0:
            if at < spans[i][1]:
                holders.append(spans[i])
            i = up[i]
        return holders[::-1]

    for m in _CALL.finditer(text):
        name = re.sub(r"\s+", "", m[1])
        parts = re.split(r"\?\.|\.|::|->|:", name)
        if parts[0] in _NO_CALL and not (len(parts) > 1 and parts[0] in ("this", "self", "super")) or m.end() - 1 in heads:
            continue
        if parts[0] == "super":
            parts[0] = "super()"
        holders = around(m.start())
        classes = [s[2] for s in holders if s[3] in ("Class", "Interface", "Enum")]
        line = bisect_left(breaks, m.start(1)) + 1
        for caller in [out.module, *(s[2] for s in holders if s[3] in ("Function", "Method"))]:
            out.put("call", parent=caller, name=".".join(parts), target=classes[-1] if classes else None, start_line=line)
    for pattern in _TYPED.get(language, []):
        for m in re.finditer(pattern, text, re.M):
            a, b = (m[2], m[1]) if pattern in _TYPED["java"] else (m[1], m[2])
            if b in _KEYWORDS or a in _KEYWORDS or b in ("return", "new", "else", "package", "import"):
                continue
            holders = around(m.start(1))
            inner = holders[-1] if holders else None
            field = inner is not None and inner[3] in ("Class", "Interface", "Enum")
            classes = [s[2] for s in holders if s[3] in ("Class", "Interface", "Enum")]
            scope = classes[-1] if a.startswith("this.") and classes else inner[2] if inner else out.module
            line = bisect_left(breaks, m.start(1)) + 1
            for name in (a, f"this.{a}") if field and not a.startswith("this.") else (a,):
                out.put("variable", parent=scope, name=name, target=b, start_line=line)


def _end(text: str, at: int, language: str) -> int:
    """Where the body of a declaration ends."""
    if language == "lua":
        depth = 1
        for m in re.finditer(r"\b(function|do|if|repeat|end|until)\b", text[at:]):
            depth += -1 if m[1] in ("end", "until") else 1
            if depth == 0:
                return at + m.end()
        return len(text)
    opened = text.find("{", at)
    stop = text.find(";", at)
    if opened < 0 or (0 <= stop < opened):
        return stop if stop >= 0 else len(text)
    depth = 0
    for m in re.finditer(r"[{}]", text[opened:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return opened + m.end()
    return len(text)


def facts_of(project: str, path: str, text: str) -> list[dict]:
    """All facts of a file; a file that doesn't parse gives its module only."""
    out = _Facts(project, path)
    language = language_of(path)
    if not language:
        return []
    out.put("definition", name=path.rsplit("/", 1)[-1], qualified_name=out.module, label="Module", start_line=1, decorators=[])
    kept = len(out)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        if language == "python":
            _python(out, text)
        else:
            _braced(out, text, language)
    except (SyntaxError, ValueError, RecursionError):
        del out[kept:]
    return list(out)


def facts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The facts of the files (`project`, `path`, `content`); rows without project, path or content give nothing."""

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [x for p, q, t in zip(*(c.to_pylist() for c in part.columns)) for x in facts_of(p, q, t)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    rows = files.where(F.col("project").isNotNull() & F.col(path).isNotNull() & F.col(content).isNotNull())
    return rows.select("project", F.col(path).alias("path"), F.col(content).cast("string").alias("content")).mapInArrow(run, SCHEMA)
