import pytest

from pyspark.sql import functions as F

from canopy.functions import names
from canopy.operators import incremental, resolve
from canopy.sources import extract, manifests, repository

FILES = {
    "app/__init__.py": "",
    "app/base.py": "class Base:\n    def run(self):\n        return self.step()\n\n    def step(self):\n        pass\n\n    def only_base(self):\n        pass\n",
    "app/main.py": "from app.base import Base\nfrom .tools import *\nimport app.tools as t\nimport os\n\n\nclass Main(Base):\n    def step(self):\n        super().step()\n        self.only_base()\n        helper()\n\n\ndef start():\n    m = Main()\n    m.run()\n    t.helper()\n    missing()\n    far()\n    os.getcwd()\n",
    "app/tools.py": "def helper():\n    return 1\n",
    "lib/far.py": "def far():\n    return 2\n",
    "bad.py": "def x(:\n",
    "web/a.js": "import { b as c } from './b';\nexport class K extends L {\n  foo(x) { return 1; }\n}\nconst h = (x) => { return x; };\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("p", k, v) for k, v in FILES.items()] + [("p", None, "x"), (None, "a.py", "x = 1"), ("p", "n.py", None)], "project string, path string, content string")
    return resolve.Facts(extract.facts(files))


def test_definitions(facts):
    got = {r.qualified_name: (r.label, r.parent_label) for r in facts.definitions.collect()}
    assert got["p.app.main.Main.step"] == ("Method", "Class") and got["p.app.main.start"] == ("Function", "Module")
    assert got["p.web.a.K.foo"] == ("Method", "Class") and got["p.web.a.h"] == ("Function", "Module")
    assert got["p.app"][0] == "Module" and "p.bad" in got and "p.bad.x" not in got


def test_imports(facts):
    got = {(r.module, r.target): r.is_external for r in resolve.import_targets(facts).collect()}
    assert got[("p.app.main", "p.app.base")] is False and got[("p.app.main", "p.app.tools")] is False
    assert got[("p.app.main", "os")] is True and got[("p.web.a", "p.web.b")] is True


def test_calls(facts):
    up = resolve.parents(facts)
    assert {(r.src, r.dst, r.type) for r in up.collect()} >= {("p.app.main.Main", "p.app.base.Base", "INHERITS")}
    got = {(r.caller, r.name): (r.target, r.tier) for r in resolve.resolve_calls(facts, up).collect()}
    assert got[("p.app.main.Main.step", "super().step")] == ("p.app.base.Base.step", 0)
    assert got[("p.app.main.Main.step", "self.only_base")] == ("p.app.base.Base.only_base", 4)
    assert got[("p.app.main.Main.step", "helper")] == ("p.app.tools.helper", 5)
    assert got[("p.app.main.start", "Main")] == ("p.app.main.Main", 6)
    assert got[("p.app.main.start", "m.run")] == ("p.app.base.Base.run", 2)
    assert got[("p.app.main.start", "t.helper")] == ("p.app.tools.helper", 3)
    assert got[("p.app.main.start", "far")] == ("p.lib.far.far", 8)
    assert got[("p.app.main.start", "missing")] == (None, None)
    assert got[("p.app.base.Base.run", "self.step")] == ("p.app.base.Base.step", 4)
    assert {tuple(r) for r in resolve.overrides(facts, up).collect()} == {("p.app.main.Main.step", "p.app.base.Base.step")}


def test_calls_are_resolved_once_a_name(spark, monkeypatch):
    """What is kept on the way follows the names, not the lines that call them or the names that nobody defines."""
    kept = []
    for module in (resolve, names):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: kept.append(cut(df)) or kept[-1])
    text = "def f():\n" + "    far()\n" * 60 + "    x.nobody()\n" * 60
    f = resolve.Facts(extract.facts(spark.createDataFrame([("p", "a.py", text), ("p", "b.py", "def far():\n    pass\n")], "project string, path string, content string")))
    got = resolve.resolve_calls(f, resolve.parents(f)).collect()
    assert {(r.caller, r.name, r.target, r.tier) for r in got} == {(c, *x) for c in ("p.a", "p.a.f") for x in (("far", "p.b.far", 8), ("x.nobody", None, None))}
    assert len(got) == 240 and max(df.count() for df in kept[1:]) <= 2 and kept[-1].count() == 1


def test_structure(spark):
    files = spark.createDataFrame([("p", k) for k in FILES] + [("p", "app/__init__.py")], "project string, path string")
    got = {(r.label, r.key): (r.parent_label, r.parent_key, r.type) for r in repository.structure(files).collect()}
    assert got[("Project", "p")] == (None, None, None)
    assert got[("Package", "p.app")] == ("Project", "p", "CONTAINS_PACKAGE") and got[("Folder", "lib")] == ("Project", "p", "CONTAINS_FOLDER")
    assert got[("File", "app/main.py")] == ("Package", "p.app", "CONTAINS_FILE") and got[("File", "bad.py")] == ("Project", "p", "CONTAINS_FILE")


def test_scan(spark, tmp_path):
    for name in ("src/a.py", "node_modules/b.js", "c.pyc"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.path for r in repository.scan(spark, str(tmp_path), "p").collect()] == ["src/a.py"]
    files = repository.scan(spark, str(tmp_path), "p", unignore=("node_modules",))
    assert [r.name for r in repository.children(files, ".").collect()] == ["node_modules", "src"]
    dirs = spark.createDataFrame([("p", "a/build/x/y.py"), ("p", "b/build/z.py"), ("p", "a/b/c/build/q.py")], "project string, path string")
    assert [tuple(r) for r in repository.ignored_directories(dirs, 2).collect()] == [("build", ["a/build", "b/build"])]


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("requirements.txt", "# c\n-r x\nrequests[security]>=2.28.0\n\nflask\n", [("requests", ">=2.28.0"), ("flask", "")]),
        ("pyproject.toml", '[project]\ndependencies=["click>=8.0"]\n[project.optional-dependencies]\ndev=["pytest"]\n[tool.poetry.dependencies]\npython="^3"\nrich="1"\n', [("rich", "1"), ("click", "click>=8.0"), ("pytest", "pytest")]),
        ("package.json", '{"dependencies":{"a":"1"},"devDependencies":{"b":"2"},"peerDependencies":{"c":"3"}}', [("a", "1"), ("b", "2"), ("c", "3")]),
        ("Cargo.toml", '[dependencies]\nserde={version="1.0"}\nx="2"\n[dev-dependencies]\ny={path="."}\n', [("serde", "1.0"), ("x", "2"), ("y", "")]),
        ("go.mod", "module m\nrequire a/b v1\nrequire (\n  c/d v2 // indirect\n  // e/f v3\n)\n", [("a/b", "v1"), ("c/d", "v2")]),
        ("Gemfile", "source 'x'\ngem 'rails', '~> 7'\ngem \"puma\"\n", [("rails", "~> 7"), ("puma", "")]),
        ("Gemfile", "# gem 'x'\ngem('rack', \"1\", require: false)\n  gem 'pg', group: :db\ngems 'no'\n", [("rack", "1"), ("pg", "")]),
        ("go.mod", "module m\nrequire(\n a/b v1 // indirect\n)\nreplace (\n c/d => e/f v2\n)\nexclude g/h v3\nrequire i/j v4\n", [("a/b", "v1"), ("i/j", "v4")]),
        ("composer.json", '{"require":{"php":"8","a/b":"1"},"require-dev":{"c":"2"}}', [("a/b", "1"), ("c", "2")]),
        ("x.csproj", '<Project><ItemGroup><PackageReference Include="N" Version="1"/><PackageReference Include="M"/></ItemGroup></Project>', [("N", "1"), ("M", "")]),
        ("package.json", "{broken", []),
        ("other.txt", "a==1", []),
    ],
)
def test_manifests(name, text, want):
    assert [(n, s) for n, s, _ in manifests.parse("dir/" + name, text)] == want


def test_dependencies(spark):
    files = spark.createDataFrame([("p", "requirements.txt", "Python>=3\nattrs\n"), ("p", "a.py", "x"), ("p", None, None)], "project string, path string, content string")
    assert [(r.name, r.spec) for r in manifests.dependencies(files).collect()] == [("attrs", "")]


def test_dependency_graph(spark):
    files = spark.createDataFrame([("p", "requirements.txt", "attrs>=1\nflask\n"), ("p", "sub/requirements.txt", "attrs>=2\n"), ("p", "pyproject.toml", '[project.optional-dependencies]\ndev=["pytest>=7"]\n'), ("p", "x.py", "attrs"), (None, None, None)], "project string, path string, content string")
    nodes, edges = manifests.dependency_graph(files)
    assert {(r.label, r.key, r.value) for r in nodes.collect()} == {("ExternalPackage", n, n) for n in ("attrs", "flask", "pytest")}
    assert {(r.from_key, r.to_key, r.properties["version_spec"], r.properties.get("group"), r.seq) for r in edges.collect()} == {("p", "attrs", ">=1", None, 1), ("p", "attrs", ">=2", None, 2), ("p", "flask", "", None, 1), ("p", "pytest", "pytest>=7", "dev", 1)}


def test_update_equals_rebuild(spark, tmp_path):
    schema = "project string, path string, content string"
    names = lambda df: df.select("project", "path", F.explode(F.split("content", " ")).alias("name"))
    old = spark.createDataFrame([("p", "a.py", "x y"), ("p", "b.py", "z"), ("p", "c.py", "w")], schema)
    new = spark.createDataFrame([("p", "a.py", "x y"), ("p", "b.py", "z2 q"), ("p", "d.py", "v")], schema)
    none = names(old.limit(0)), incremental.load_state(spark, str(tmp_path / "none"))
    facts, state, status = incremental.update(*none, old, names)
    assert {r.status for r in status.collect()} == {"new"} and facts.count() == 4
    incremental.save_state(state, str(tmp_path / "state"))
    seen = []
    facts, state, status = incremental.update(facts, incremental.load_state(spark, str(tmp_path / "state")), new, lambda df: seen.append(df) or names(df))
    assert {(r.path, r.status) for r in status.collect()} == {("a.py", "unchanged"), ("b.py", "changed"), ("c.py", "deleted"), ("d.py", "new")}
    assert {r.path for r in seen[0].collect()} == {"b.py", "d.py"}  # only these are parsed
    assert {tuple(r) for r in facts.collect()} == {tuple(r) for r in names(new).collect()} and state.count() == 3
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no table")
    assert incremental.load_state(spark, str(tmp_path / "broken")).count() == 0


#: Small repositories in other languages: each call as caller, name and target.
CALLS = {
    "javascript": (
        {
            "src/store.js": "export class Store {\n  constructor() { this.log = new Log(); }\n  get(k) { return this.find(k); }\n  find(k) { this.log.write(k); return JSON.parse(k); }\n}\nexport class Log {\n  write(x) { console.log(x); }\n}\nexport class Deep extends Store {\n  get(k) { return super.get(k); }\n}\n",
            "src/app.js": "import { Store } from './store';\nfunction run() {\n  const s = new Store();\n  s.get('a(');\n  helper(); // skipped()\n}\nfunction helper() { run.call(null); }\n",
        },
        {("src.store.Store.get", "this.find", "src.store.Store.find"), ("src.store.Store.find", "this.log.write", "src.store.Log.write"), ("src.store.Store.find", "JSON.parse", "builtin.JSON.parse"), ("src.store.Log.write", "console.log", "builtin.console.log"), ("src.store.Deep.get", "super().get", "src.store.Store.get"), ("src.app.run", "Store", "src.store.Store"), ("src.app.run", "s.get", "src.store.Store.get"), ("src.app.run", "helper", "src.app.helper"), ("src.app.helper", "run.call", "builtin.Function.prototype.call")},
    ),
    "java": (
        {"a/Base.java": "package a;\npublic class Base {\n  int size() { return 1; }\n}\n", "a/Main.java": "package a;\nimport a.Base;\nclass Main extends Base {\n  private Base other;\n  int all(Base b) {\n    Base c = new Base();\n    return this.size() + b.size() + c.size() + this.other.size() + twice(2);\n  }\n  int twice(int x) { return x * 2; }\n}\n"},
        {("a.Main.Main.all", "this.size", "a.Base.Base.size"), ("a.Main.Main.all", "b.size", "a.Base.Base.size"), ("a.Main.Main.all", "c.size", "a.Base.Base.size"), ("a.Main.Main.all", "this.other.size", "a.Base.Base.size"), ("a.Main.Main.all", "twice", "a.Main.Main.twice")},
    ),
    "go": (
        {"m/a.go": "package m\n\ntype Tree struct{}\n\nfunc (t *Tree) Walk() { t.step() }\n\nfunc (t *Tree) step() {}\n\nfunc Run() {\n\tx := &Tree{}\n\tx.Walk()\n\thelp()\n}\n\nfunc help() {}\n"},
        {("m.a.Tree.Walk", "t.step", "m.a.Tree.step"), ("m.a.Run", "x.Walk", "m.a.Tree.Walk"), ("m.a.Run", "help", "m.a.help")},
    ),
    "lua": (
        {"w/queue.lua": "local Queue = {}\nfunction Queue.new() return {} end\nfunction Queue:push(x) end\nreturn Queue\n", "w/main.lua": "local Queue = require('w.queue')\nlocal function run()\n  local q = Queue.new()\n  q:push(1)\nend\nrun()\n"},
        {("w.main.run", "q.push", "w.queue.Queue.push"), ("w.main.run", "Queue.new", "w.queue.Queue.new"), ("w.main", "run", "w.main.run")},
    ),
}


@pytest.mark.parametrize("language", list(CALLS))
def test_calls_of_other_languages(spark, language):
    files, want = CALLS[language]
    f = resolve.Facts(extract.facts(spark.createDataFrame([("p", p, t) for p, t in files.items()], "project string, path string, content string")))
    found = {(r.caller.removeprefix("p."), r.name, (r.target or "").removeprefix("p.")) for r in resolve.resolve_calls(f, resolve.parents(f)).collect()}
    assert want <= found, sorted(want - found) + sorted(found)
    assert not any("skipped" in n for _, n, _ in found)
