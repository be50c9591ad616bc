from canopy.__main__ import main, open_graph

FILES = {
    "app/__init__.py": "",
    "app/base.py": "class Base:\n    def run(self):\n        return self.step()\n\n    def step(self):\n        pass\n",
    "app/main.py": "from app.base import Base\nimport os\n\n\nclass Main(Base):\n    @cached\n    def step(self):\n        return helper()\n\n\ndef helper():\n    return Main().run()\n",
    "web/a.js": "export function go() { stop(); }\nfunction stop() {}\n",
    "requirements.txt": "attrs>=1\n",
    "node_modules/x/skipped.js": "function no() {}\n",
}


def test_index_and_commands(spark, tmp_path, capsys):
    root, out = tmp_path / "repo", str(tmp_path / "graph")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    assert main(["index", str(root), out, "--project", "p"], spark) == 0
    g = open_graph(spark, out)
    nodes = {(r.labels[0], r.properties.get("qualified_name") or r.properties.get("path") or r.properties["name"]) for r in g.nodes.collect()}
    assert nodes >= {("Project", "p"), ("Package", "p.app"), ("Folder", "web"), ("File", "app/main.py"), ("File", "requirements.txt"), ("Module", "p.app.main"), ("Class", "p.app.main.Main"), ("Method", "p.app.main.Main.step"), ("Function", "p.app.main.helper"), ("Module", "os"), ("ExternalPackage", "attrs"), ("Function", "p.web.a.go")}
    assert not any("skipped" in n for _, n in nodes)
    name = {r.node_id: r.properties.get("qualified_name") or r.properties.get("path") or r.properties["name"] for r in g.nodes.collect()}
    edges = {(name[r.from_id], r.type, name[r.to_id]) for r in g.edges.collect()}
    assert edges >= {
        ("p", "CONTAINS_PACKAGE", "p.app"), ("p", "CONTAINS_FOLDER", "web"), ("p.app", "CONTAINS_FILE", "app/main.py"), ("p.app", "CONTAINS_MODULE", "p.app.main"), ("p.app.main", "DEFINES", "p.app.main.helper"), ("p.app.main.Main", "DEFINES_METHOD", "p.app.main.Main.step"),
        ("p.app.main", "IMPORTS", "p.app.base"), ("p.app.main", "IMPORTS", "os"), ("p.app.main.Main", "INHERITS", "p.app.base.Base"), ("p.app.main.Main.step", "OVERRIDES", "p.app.base.Base.step"), ("p.app.main.Main.step", "CALLS", "p.app.main.helper"), ("p.web.a.go", "CALLS", "p.web.a.stop"), ("p", "DEPENDS_ON_EXTERNAL", "attrs"),
    }
    assert [r.name for r in g.cypher("MATCH (n:Method) WHERE '@cached' IN n.decorators RETURN n.name AS name").collect()] == ["step"]
    assert main(["stats", out], spark) == 0 and main(["query", out, "MATCH (c:Class) RETURN c.name AS name ORDER BY c.name"], spark) == 0
    said = capsys.readouterr().out
    assert "DEFINES_METHOD" in said and "Main" in said
    assert main(["export", out, str(tmp_path / "json")], spark) == 0 and (tmp_path / "json" / "nodes").exists()
