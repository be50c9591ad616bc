import pytest

from canopy.llm import functions, provenance, unparsed
from canopy.llm.syntax.check import diagnose, language_of, plain, tokens_of, valid
from canopy.llm.syntax.gll import GLL
from canopy.llm.syntax.peg import Grammar

VALID = {
    "py": ["", "\n# only a comment\n", "x = 1\nif x:\n    pass\nelif (y := 2):\n  z = [i for i in range(3) if i]\nelse: pass\n", "@d(1)\nasync def f(a, /, b=1, *c, d: int = 2, **e) -> list[int]:\n    '''doc'''\n    async with a as b, c: return await x\n", "class A(B, metaclass=M):\n    x: int = 3\n    def f(self): yield from g()\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': A(b=1) | None as q}: pass\n    case _: pass\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "x = f'{a}' 'b' \"c\"\nprint(*a, **b, sep='')\nlambda *a, k=1: (yield)\nx[1:2, ::3] = y = ...\ndel a, b; global c\n", "from . import a\nfrom ..x.y import (a as b,\n  c,)\nimport a.b as c, d\n", "type X[T: int] = list[T]\ndef f[T](x: T): ...\n", "with (open(a) as b, c):\n\n    # c\n    pass\n"],
    "js": ["a ? b : c\nlet {x, y: [z = 1], ...r} = q\nfor (const [k, v] of o) { continue }\nfor (;;) {}\n", "export default async function* f(a, {b}, ...c) { yield* x; await y }\nclass A extends (B) { static #p = 1; get x() { return this.#p } static { q() } async *g() {} [k] = 2 }\n", "const r = /[/{]+x/gi.test(s) / 2\nlabel: while (1) { break label }\nx = a?.b?.[c] ?? `t${d}`\n", "import a, { b as c } from './d'\nimport * as e from 'f'\nexport * from 'g'\nexport { h as default }\n", "switch (a) { case 1: case 2: f(); break; default: g() }\nif (a) b(); else if (c) d\nelse { e }\ntry { x } catch { y } finally { z }\nvar f = async x => ({ x, y() {}, get z() { return 1 }, ['k']: 2, async *w() {} })\n", "foo\n  .bar()\n  .baz(function () { return 1 })\nnew X\nnew a.b(c)\ndo x++; while (x < 5)\n"],
    "ts": ["interface A<T extends B = C> extends D<T> { readonly x?: string; [k: string]: any; (a: number): void; m<U>(u: U): u is V }\n", "type X<T> = T extends (infer U)[] ? U : { [K in keyof T]?: T[K] } | 'a' | -1 | [a: string, b?: number]\n", "abstract class A<T> implements B, C { private readonly x: Map<string, Array<number>> = new Map(); constructor(public a: string, b?: number) { super() } abstract f(): void; get y(): number { return 1 } static z!: string }\n", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nnamespace N.M { let z = 1 }\nexport type { Q } from './q'\nfunction f<T>(this: X, a: T, ...r: T[]): asserts a is T { return (a as any) as unknown as T }\nlet v = <const T,>(x: T) => x!\n", "function o(a: string): void\nfunction o(a: any) { return a satisfies B }\n@dec() class Z { @inp() x = 1 }\nconst g = f<string>(1)\n"],
    "java": ["package a.b;\nimport static java.util.*;\n@A(x = {1, 2}) public final class C<T extends D & E> extends F<T> implements G, H {\n  private static final int[] x = {1, 2}, y[] = new int[3][];\n  C(int... a) throws X { this(); }\n  @Override public <U> Map<String, List<U>> f(final U u) { for (String s : u) { if (s == null) continue; } return (List<String>) z; }\n  static { int i = 0; }\n  abstract void g();\n}\n", "record P(int x, String y) implements Q { P { if (x < 0) throw new E(); } }\ninterface I { default int f() { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } }\nenum E { A(1) { void f() {} }, B; int x; }\n", "class A { void f() { Runnable r = () -> {}; Function<A, B> g = A::new; var s = \"\"\"\n text \"\"\"; try (var a = b(); c) { } catch (X | Y e) { } finally { } int i = a > b ? 1 : 2 >>> 3; x = (int) y; if (o instanceof String t && t.isEmpty()) {} char c = '\\u0041'; synchronized (this) { do { i++; } while (i < 3); } lbl: for (int k = 0, m = 1; k < m; k++, m--) break lbl; new A() { int q; }.toString(); } }\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\ntype I interface {\n\tM(a int) (b string, err error)\n\t~int | string\n}\n\nfunc (t *T) F(a, b int, c ...string) (x map[string][]int, err error) {\n\tif v, ok := m[k]; !ok {\n\t\treturn nil, fmt.Errorf(\"x %w\", err)\n\t} else if v > 1 {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\t\tf()\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\tgo func() { defer f() }()\n\ta[1:2] = T{A: 1, B: []int{1, 2}, C: {3}}\n\tvar z = '\\n'\n\treturn\n}\n"],
    "lua": ["#!/usr/bin/lua\nlocal a <const>, b = 1, 'x'\nfunction M.a.b:c(x, ...)\n  for i = 1, 10, 2 do print(i) end\n  for k, v in pairs(t) do if k then break elseif v then goto e else local z = function() return end end end\n  while not x do x = #y .. z end\n  repeat local q = 1 until q > 2\n  ::e::\n  return { 1, a = 2; [3] = f{ x = 1 } , g'str' }, (x)\nend\nf(function(a) return a end)\n--[==[ long\n]==]\nreturn M\n"],
}
BROKEN = {
    "py": ["def f(:\n  pass\n", "if x\n  pass\n", "x = (1,\n", "x = 'a\n", "  x = 1\n", "if x:\npass\n", "def f():\n    a\n  b\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "print 'x'\n", "try:\n  pass\n", "else:\n  x\n", "x = 1 +\n", "a b\n", "return return\n", "class A { }\n", "x = 3px\n"],
    "js": ["function f( { }\n", "let = ;\nconst x\n= = 2", "if (a { }\n", "class A { x y }\n", "a = 'b\n'", "def f(x):\n    return x\n", "package a\n\nfunc f() {}\n", "const x: number = 1\n", "}\n", "for (a of) {}\n", "x = [1, 2\n", "<<<<<<< a\nb()\n=======\nc()\n>>>>>>> d\n"],
    "ts": ["interface A { x: }\n", "type = 3 3\n", "function f(a: ) {}\n", "class A<T { }\n", "local x = 1\nend\n"],
    "java": ["class A { int x }\n", "public class A { void f() { return 1 } }\n", "class A { void f( { } }\n", "class A { String s = \"x; }\n", "class A {\n", "import { a } from 'b';\n", "class A { void f() { if (x) } }\n"],
    "go": ["func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nfunc f() { x := }\n", "package a\nvar x = \"a\n", "package a\nclass A {}\n", "package a\nfunc f() {\n"],
    "lua": ["function f(\nend\n", "if x then\n", "local x = \n", "x = 'a\n", "end\n", "for i in do end\n", "repeat x = 1\n", "function f() return 1 end end\n", "if x then y else z end\n", "return 1 local x\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(language, text):
    assert valid(text, language), diagnose(text, language)
    assert valid(text.replace("\n", "\r\n"), language)


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in BROKEN.items() for t in ts])
def test_broken(language, text):
    assert not valid(text, language)
    line, column, cause = diagnose(text, language)
    assert 1 <= line <= text.count("\n") + 2 and column >= 1 and cause


def test_causes():
    assert diagnose("x = 1\n<<<<<<< a\n", "py")[::2] == (2, "merge conflict")
    assert diagnose("x = 1\ny = (2\n", "py") == (2, 5, "unclosed bracket")
    assert diagnose("f(1, , 2)\n", "js") == (1, 6, "unexpected token")
    assert diagnose("a = 1\nb = 1 2\n", "py") == (2, 7, "unexpected token")
    assert diagnose("if x then\n  y()\n", "lua")[::2] == (1, "unclosed block")
    assert diagnose("a = 'x\n", "js")[2] == "unclosed string"
    assert language_of("a/B.PY") == "py" and language_of("x") is None and language_of(None) is None


def test_peg_is_ordered_and_greedy():
    g = Grammar("s = 'a' / 'a' 'b'\nt = 'a'* 'a'\nu = !'b' ('a' / 'b')+ EOF\n", {}, set(), set())
    a, b = g.char("a"), g.char("b")
    assert g.parse("s", a + b) == (False, 1) and not g.matches("t", a + a) and g.matches("u", a + b) and not g.matches("u", b)


def test_gll_ambiguity_left_recursion_and_skips():
    g = GLL("s = s 'a' / 'a' / @x 'b' s\n")
    assert g.parse("s", "aaa")[0] == 1 and g.parse("s", "ba") == (2, {"x": 0}) and g.parse("s", "c") is None
    assert g.parse("s", "bca", 1) == (3, {"x": 0})


ROW = "project string, file_path string, language string, label string, qualified_name string, source_code string, docstring string, found boolean, error_message string"


def module(path, text, found=True, message=None, project="p", qn="p.m", label="Module", doc=None):
    return (project, path, None, label, qn, text, doc, found, message)


def test_unparsed(spark):
    rows = [module("a.py", "x = (\n"), module("a.py", "x = (\n"), module("b.py", "x = 1\n"), module("c.py", None, False, "invalid syntax (line 3)"), module("d.py", None, False, "[Errno 2] No such file or directory: 'syntax.py'"), module("e.txt", "((("), module(None, "x = ("), module("", "x = ("), module("f.py", ""), module("g.py", "x = (", label="Function"), module("h.js", "a b", project=None)]
    df = spark.createDataFrame(rows, ROW).withColumnRenamed("language", "cause")
    assert {tuple(r) for r in unparsed.unparsed(df).collect()} == {("p", "a.py"), ("p", "c.py"), (None, "h.js")}
    rates = {(r.project, r.language): (r.n_files, r.n_unparsed) for r in unparsed.rates(df).collect()}
    assert rates[("p", "py")] == (5, 2) and rates[("p", None)] == (1, 0)
    assert unparsed.rates(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("message", "says"),
    [("parse failed: merge markers found", True), ("tree contains ERROR nodes, first one at line 3", True), ("Unbalanced block in lib/timeout/stale.go, giving up", True), ("'utf-8' codec can't decode byte 0xe9", False), ("timed out after 9 ms while waiting for the parser queue", False), ("Entity 'a.SyntaxError' not found in graph.", False), ("slow read", False), (None, False), ("", False)],
)
def test_messages(message, says):
    assert unparsed.says_unparsed(message) is says


def names(text, language, part=False):
    return [(".".join(n), d) for n, d, _ in functions.scan(tokens_of(plain(text), language), language, part) if d]


def test_functions_by_language():
    py = 'class A:\n    """c"""\n    def f(self):\n        """One two three four."""\n        def g(): "inner doc here now"\n\n    async def h(self,\n            x: int = (1)) -> dict[str, int]:  # c\n        # note\n        r\'\'\'raw doc\'\'\'\ndef k():\n    x = "no doc"\n'
    assert [n for n, _ in names(py, "py")] == ["A.f", "A.f.g", "A.h"]
    js = "/** class */\nexport class A extends B {\n  /** m1 */\n  async m(a) { }\n  /** g */\n  get x() { return 1 }\n  /** field */\n  f = () => { }\n}\n/** top */\nexport default function top() {\n  /** in */\n  const inner = async (a, b) => { return a }\n}\n/** gone */\n\nfunction blank() {}\n// no\nfunction plain() {}\n/** call */\ndoIt(function () {})\n/** bound */\nmodule.exports.q = function (a) { }\n"
    assert [n for n, _ in names(js, "js")] == ["A.m", "A.x", "A.f", "top", "top.inner", "q"]
    ts = "/** d */\n@Dec({a: 1})\nexport abstract class K<T> {\n  /** m */\n  @Log() private static async go<T extends X>(a: Map<string, T[]>, b?: {x: number}): Promise<{y: T}> { }\n}\n/** fn */\nexport const f = <T,>(x: T): Record<string, T> => { return x }\n"
    assert [n for n, _ in names(ts, "ts")] == ["K.go", "f"]
    java = "public class A<T> {\n    /** c */\n    public A(int x) { }\n    /** m */\n    @Override\n    @SuppressWarnings(\"x\")\n    protected static <U> Map<String, List<U>> m(final U u, int[] v) throws X, Y { }\n    enum E { P; /** e */ void e() { } }\n    interface I { /** i */ int i(); }\n    /** field */\n    int z = 3;\n}\n"
    assert [n for n, _ in names(java, "java")] == ["A.A", "A.m", "A.E.e", "A.I.i"]
    go = "package a\n\n// F is it.\n// More.\nfunc F(a int) (b string) {\n\t// g does.\n\tg := func() {}\n}\n\n// M on T.\nfunc (t *T[K]) M() {}\n// detached\n\nfunc G() {}\n"
    assert [n for n, _ in names(go, "go")] == ["F", "F.g", "T.M"]
    lua = "--- Doc a.\n--- @param x\nfunction M.a(x)\n  --- inner\n  local function b() end\nend\n--- c\nM.c = function() end\n-- plain\nfunction M.d() end\n--- e\nlocal e = function() if x then y() end end\n--- f\nfunction M:f() end\n"
    assert [n for n, _ in names(lua, "lua")] == ["a", "a.b", "c", "e", "f"]


SCRIPTS = [
    "`a ${`b`} c`;", "if (a) /re/.test(b);", "const x = a && /x\"y/.test(b);", "const f = x => /re/g;", "x = `a ${b ? `c ${d}` : ''} e`;", "tag`x ${a} y ${b}`;", "let q = (a) / b / c;", "const z = {a: 1}; `p ${{a:1}.a} q`", "while (i--) /a/.exec(s)",
    "let r = a ? /b/ : /c/; x = [/a/, /b/];", "`${a}${b}`;", "return_ = 1 / 2 / 3", "function f() { return /a[/]b/.test(`${x}`) }", "for (const k of /a/g.exec(s)) {}", "const y = a.in / 2 / 3;", "x = `\\${a} \\``;", "if (x) { y = `${a}` } else { z = `${b}` }",
    "const o = {f(a) { return `${a}` }, ...b};", "s.replace(/\\//g, '/').split(/[,;]/)",
]
FIELDS = ["f\"{a}\"", "f'{a!r:>{w}} {{}} {b=}'", "f\"{d['k']} {x[\"a\"]}\"", "f'{a:%Y-%m-%d}'", "rf'\\d{n}'", "f'{(lambda: 1)()}'", "f'''{a}\n{b}'''", "f\"{', '.join(v)}\"", "f'\\N{DASH}'", "f'{a if b else c}' 'd'", "f'{a != b}'"]


@pytest.mark.parametrize(("language", "text"), [*(("js", t) for t in SCRIPTS), *(("ts", t) for t in [*SCRIPTS, "type K = `get${string}`;", "const x: string = `a ${b as string} c`;"]), *(("py", "x = " + t) for t in FIELDS)])
def test_templates_regular_expressions_and_fields(language, text):
    assert valid(text, language)


@pytest.mark.parametrize(("language", "text"), [*(("js", t) for t in ("`a ${ } c`", "`a ${b c`", "x = `a ${b c} d`", "if (a) /re.test(b);", "`${a`")), ("ts", "const x = `a ${b as} c`;"), *(("py", f"x = f{t}") for t in ('"{a b}"', "'{}'", "'{a'", "'a}'", "'{a!x}'"))])
def test_broken_templates_and_fields(language, text):
    assert not valid(text, language) and diagnose(text, language)


def test_broken_files_still_give_functions():
    assert [n for n, _ in names("/** one */\nfunction a() { }\nfunction x( {\n/** two */\nfunction b() { }\n", "js")][:1] == ["a"]


@pytest.mark.parametrize(
    ("text", "trivial"),
    [("Walk all nodes of it.", False), ("Helper.", True), ("", True), ("TODO: describe what this does here", True), ("fixme - write it all down please", True), ("No description has been provided yet.", True), ("Missing documentation, please fill this in.", True), ("Auto-generated stub, description to be added.", True), ("Docs pending.", True), ("Return the missing documentation of a node.", False), ("Do it.\n\n@param x one two three four", True), ("Args:\n    x: one two three four five", True), (":param x: one two three four five", True), ("Return all the found nodes.\n\nReturns:\n  x", False)],
)
def test_trivial(text, trivial):
    assert functions.is_trivial(text) is trivial


def test_pairs(spark):
    doc = "Walk all of the nodes."
    rows = [
        module("a.py", f'def f():\n    """{doc}"""\n'), module("a.py", f'def f():\n    """{doc}"""\n'), module("b.py", f'def f(:\n    """{doc}"""\n', qn="p.b"), module("b.py", "def g(): pass", qn="p.b.g", label="Function", doc=doc), module(None, "function h() {}", qn="p.h", label="Function", doc=doc),
        module("c.py", f'def f():\n    """{doc}"""\n    def inner():\n        """{doc}"""\n', qn="p.c.f", label="Method"), module("d.py", f'def f():\n    """{doc}"""\n', qn=None), module("e.py", f'def f():\n    """{doc}"""\n', found=False, qn="p.e"), module("f.py", None, qn="p.f"), module("g.py", f'def f():\n    """{doc}"""\n', project=None, qn="g"),
    ]
    df = spark.createDataFrame(rows, ROW)
    found = {tuple(r) for r in functions.documented_names(df).collect()}
    assert found == {("p", "p.m.f"), ("p", "p.h"), ("p", "p.c.f"), ("p", "p.c.f.inner"), (None, "g.f")}
    assert {r.documentation for r in functions.pairs(df).collect()} == {doc}
    got = functions.pairs(df)
    # The broken file's functions are pairs too, marked as such.
    assert {(r.qualified_name, r.broken) for r in got.collect()} >= {(n, False) for _, n in found} | {("p.b.g", True)}
    n = got.count()
    assert functions.pairs(df, share=0.1).count() == 0 and functions.pairs(df, share=1.0).count() == n
    assert functions.pairs(df.limit(0), share=0.1).count() == 0


def test_provenance(spark):
    code = "import os\n\n\ndef work(a, b):\n    for x in a:\n        if x == b:\n            return os.path.join(x, b)\n    return None\n" * 3
    mini = "!function(){" + "".join(f"var a{i}=(t,e)=>t+e*{i}+t.k;function b{i}(n){{return n.q}}" for i in range(60)) + "}();"
    blob = "DATA = [\n" + "    1234, 5678, 9012, 3456,\n" * 60 + "]\n"
    rows = [
        module("src/a.py", code), module("src/b.py", "# Code generated by x-gen v1. DO NOT EDIT.\n" + code), module("src/c.py", "# Writes the 'DO NOT EDIT' banner into generated files.\n" + code), module("vendor/lib-1.2/deep/er/d.py", code), module("vendor_portal/e.py", code), module("src/f.js", mini), module("src/g.py", blob),
        module("third_party/x/h.py", code), module("src/i_pb2.py", code), module("src/j.py", code, found=False), module(None, code), module("", code), module("src/k.py", None), module("src/a.py", code), module("src/l.py", "# Bundled copy of abc 1.2.3 - see upstream for history\n" + code, project=None), module("vendor/q/m.py", "def f(): pass", label="Function"),
    ]
    df = spark.createDataFrame(rows, ROW)
    got = {(r.project, r.file_path): r.label for r in provenance.beliefs(df).collect()}
    want = {"src/a.py": "handwritten", "src/b.py": "generated", "src/c.py": "handwritten", "vendor/lib-1.2/deep/er/d.py": "vendored", "vendor_portal/e.py": "handwritten", "src/f.js": "minified", "src/g.py": "blob", "third_party/x/h.py": "vendored", "src/i_pb2.py": "generated", "src/k.py": "handwritten", "vendor/q/m.py": "vendored"}
    assert {k[1]: v for k, v in got.items() if k[0] == "p"} == want and got[(None, "src/l.py")] == "vendored"
    assert provenance.not_handwritten(df.limit(0)).count() == 0


def test_provenance_of_files_without_a_module_row(spark):
    code = "def work(a, b):\n    for x in a:\n        if x == b:\n            return join(x, b)\n    return None\n" * 3
    mini = "function z(){" + "".join(f"var a{i}=(t,e)=>t+e*{i}+t.k;function b{i}(n){{return n.q}}" for i in range(60)) + "}"
    blob = "def data():\n    x = [\n" + "    1234, 5678, 9012, 3456,\n" * 60 + "]\n"
    rows = [
        module("a/f.js", mini, label="Function"), module("a/f.js", "function y(){}", label="Function"), module("b/g.py", blob, label="Method"), module("c/h.py", code, label="Function"), module("c/i.py", None, label="Function"),
        module("d/j.js", mini, label="Function"), *[module("d/j.js", code + f"# {i}\n" * 9, label="Function") for i in range(40)], *[module("d/j.js", mini, label="Function")] * 90,
        module("e/k.py", code), module("e/k.py", blob, label="Function"), module("f/l.py", None), module("f/l.py", blob, label="Function"),
    ]
    got = {r.file_path: r.label for r in provenance.beliefs(spark.createDataFrame(rows, ROW)).collect()}
    assert got == {"a/f.js": "minified", "b/g.py": "blob", "c/h.py": "handwritten", "c/i.py": "handwritten", "d/j.js": "handwritten", "e/k.py": "handwritten", "f/l.py": "blob"}


FILES = "project string, file_path string, label string, source_code string, found boolean"
BANNER = "/*\n * tinyqueue 2.1.0, released under the MIT license\n */\nfunction f(a) {\n  return a.map((x) => x + 1).filter((x) => x > 2).reverse().concat(a).slice(1).join(', ');\n}\n"
PLAIN = "function total(rows) {\n  let sum = 0;\n  for (const row of rows) {\n    sum += row.price * row.count;\n  }\n  return sum + rows.length;\n}\n"


def test_files_without_evidence_are_labelled_by_the_tree(spark):
    copies = [("p", f"lib/queue/{'core/' if i % 2 else ''}q{i}.js", "Module", BANNER, True) for i in range(8)]
    own = [("p", f"app/{d}/f{i}.js", "Module", PLAIN, True) for d in ("one", "two", "three") for i in range(6)]
    asked = [("p", "lib/queue/plain.js", "Module", PLAIN, True), ("p", "lib/queue/util/deep/er/plain.js", "Module", PLAIN, True), ("p", "vendor/x/plain.js", "Module", PLAIN, True), ("p", "node_modules/y/plain.js", "Module", PLAIN, True), ("p", "app/plain.js", "Module", PLAIN, True)]
    got = {r.file_path: r.label for r in provenance.beliefs(spark.createDataFrame(copies + own + asked, FILES)).collect()}
    # A sibling, and a cousin through directories with plain names.
    assert got["lib/queue/plain.js"] == got["lib/queue/util/deep/er/plain.js"] == "vendored"
    # Two vendor directories say nothing of the root they stand in.
    assert got["vendor/x/plain.js"] == got["node_modules/y/plain.js"] == "vendored"
    assert got["app/plain.js"] == "handwritten" and all(got[f] == "handwritten" for _, f, *_ in own)
