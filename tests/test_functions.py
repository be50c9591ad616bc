import pytest
from pyspark.sql import functions as F

from canopy.functions import modules, names, paths, text, vector
from canopy.operators import incremental, resolve
from canopy.plans.cypher import statement_in


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("candidate", "caller", "distance"),
    [("proj.pkg.sibling_mod.some_func", "proj.pkg.caller_mod", 1), ("proj.pkg.sibling_mod.SomeClass.some_method", "proj.pkg.caller_mod", 2), ("proj.other.mod.f", "proj.pkg.caller_mod", 3), ("proj.pkg.caller_mod.f", "proj.pkg.caller_mod", 0), ("a.b", "c", 2), (None, "c", None)],
)
def test_import_distance(spark, candidate, caller, distance):
    assert one(spark, names.import_distance(F.lit(candidate).cast("string"), F.lit(caller))) == distance


def test_nearest(spark):
    wanted = spark.createDataFrame([("p.a.m", "f"), ("p.b.m", "f"), ("p.a.m", "none")], "caller string, name string")
    defs = spark.createDataFrame([("f", "p.a.x.f"), ("f", "p.b.y.C.f"), ("f", "p.b.y.f"), ("f", "q.f")], "name string, qualified_name string")
    assert {(r.caller, r.candidate, r.distance) for r in names.nearest(wanted, defs).collect()} == {("p.a.m", "p.a.x.f", 1), ("p.b.m", "p.b.y.f", 1)}


@pytest.mark.parametrize(
    ("path", "is_file", "exclude", "unignore", "skipped"),
    [
        ("src/a.py", True, [], [], False), ("src/a.pyc", True, [], ["src"], True), ("node_modules/x/a.js", True, [], [], True), ("node_modules/x/a.js", True, [], ["node_modules/x"], False), ("node_modules/x/a.js", True, ["x"], ["node_modules/x"], True),
        ("build", True, [], [], False), ("build", False, [], [], True), ("docs/a.md", True, ["docs"], [], True), ("docs2/a.md", True, ["docs"], [], False), (".bashrc", True, [], [], False), ("a/b/c.py", True, ["a/b"], [], True), (None, True, [], [], None),
    ],
)
def test_skip(spark, path, is_file, exclude, unignore, skipped):
    assert one(spark, paths.should_skip(F.lit(path).cast("string"), is_file, exclude, unignore)) is skipped


def test_path_parts(spark):
    got = [tuple(r) for r in spark.createDataFrame([("a/b.tar.gz",), (".bashrc",), ("x",)], "p string").select(paths.parent(F.col("p")), paths.name(F.col("p")), paths.suffix(F.col("p")), paths.stem(F.col("p"))).collect()]
    assert got == [("a", "b.tar.gz", ".gz", "b.tar"), (".", ".bashrc", "", ".bashrc"), (".", "x", "", "x")]
    assert paths.ignore_file("# c\n\nbuild\n!keep/me\n") == (["build"], ["keep/me"])
    assert one(spark, paths.module_name(F.lit("p"), F.lit("a/__init__.py"))) == "p.a"
    assert one(spark, paths.module_name(F.lit("p"), F.lit("__init__.py"))) == "p"


@pytest.mark.parametrize(("t", "a", "b", "want"), [("x\ny\nz", 2, 2, "y"), ("x\r\ny\r\nz\r\n", 2, 9, "y\r\nz"), ("x", 2, 3, None), ("", 1, 1, None), ("  x \n\n", 1, 2, "x"), ("x\ny", 0, 1, None), ("x\ny", 2, 1, None), (None, 1, 1, None)])
def test_line_slices(spark, t, a, b, want):
    assert one(spark, text.slice_lines(F.lit(t).cast("string"), F.lit(a), F.lit(b))) == want


def test_budget_keeps_the_first_row(spark):
    rows = spark.createDataFrame([(1, 50), (2, 10)], "k bigint, cost bigint")
    assert [r.k for r in text.within_budget(rows, ["k"], "cost", 20).collect()] == [1]
    assert text.within_budget(rows, ["k"], "cost", 60).count() == 2


def test_scores_and_names(spark):
    score = lambda p, c: one(spark, names.match_score(F.lit(p), F.lit(c)))
    assert score("user", "User") == 100 and score("my_user", "User") == 90 and score("user_service_x", "User") == 22 and score("a", "User") == 0
    assert one(spark, names.camel(F.lit("my_FOO_bar"))) == "MyFooBar"
    assert one(spark, names.last_part(F.lit("a::b"))) == "b" and one(spark, names.separator(F.lit("a:b"))) == ":"
    assert one(spark, text.requirement(F.lit(" requests[security]>=2.28.0 "))).asDict() == {"name": "requests", "extras": "security", "spec": ">=2.28.0", "marker": ""}
    assert one(spark, text.requirement(F.lit("a.b-c @ https://x/y.zip ; python_version < '3'"))).asDict() == {"name": "a.b-c", "extras": "", "spec": "@ https://x/y.zip", "marker": "python_version < '3'"}
    assert one(spark, text.requirement(F.lit(""))).asDict() == {"name": "", "extras": "", "spec": "", "marker": ""}


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0]), (5, None)], "node_id bigint, embedding array<float>")
    assert [r.node_id for r in vector.top_k(v, "node_id", "embedding", [1.0, 0.05], 9).collect()] == [1, 3, 2]
    assert {r.node_id for r in vector.top_k(v, "node_id", "embedding", [0.95, 0.05], 2).collect()} == {1, 3}


def test_changes(spark):
    kind = "path string, sha256 string"
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "1")], kind), spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], kind)
    assert {tuple(r) for r in incremental.changes(old, new, ["path"]).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "deleted")}
    assert {r.status for r in incremental.changes(old, new, ["path"], force=True).collect()} == {"new"}
    assert one(spark, incremental.content_hash(F.lit("x"))) == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_imported_entities(spark):
    of = lambda full, language, known=None: one(spark, modules.entity_module(F.lit(full), F.lit(language), None if known is None else F.lit(known)))
    assert of("os.path.join", "python") == "os.path.join" and of("os.path.join", "python", True) == "os.path" and of("a.Thing", "python") == "a"
    assert of("react.useState", "javascript") == "react" and of("react", "javascript") == "react"
    assert of("std::fmt::Display", "rust") == "std::fmt" and of("std::io::read_to", "rust") == "std::io::read_to" and of("a::b", "rust") == "a"
    assert of("std::vector", "cpp") == "std" and of("std::is_same", "cpp") == "std" and of("my::Thing", "cpp") == "my::Thing"
    assert of("net/http/Client", "go") == "net/http" and of("net/http", "go") == "net/http"
    assert of("java.io.readError", "java") == "java.io" and of("string.table", "lua") == "string" and of(None, "lua") is None


def test_statement_in_answers():
    assert statement_in("```cypher\nMATCH (n) RETURN n\n```") == "MATCH (n) RETURN n;"
    assert statement_in("**Cypher Query:** `MATCH (n) RETURN n;`") == "MATCH (n) RETURN n;"
    assert statement_in("cypher MATCH (n) RETURN n") == "MATCH (n) RETURN n;"


def test_operator_targets(spark):
    calls = spark.createDataFrame([("m.a", "operator_plus"), ("x", "operator_plus"), ("x", "operator_none"), ("x", "plus")], "module string, name string")
    defs = spark.createDataFrame([("operator_plus", "m.a.LongName.operator_plus"), ("operator_plus", "z.C.operator_plus"), ("operator_plus", "b.C.operator_plus"), ("plus", "x.plus"), (None, None)], "name string, qualified_name string")
    assert {tuple(r) for r in resolve.operator_targets(calls, defs).collect()} == {("m.a", "operator_plus", "m.a.LongName.operator_plus"), ("x", "operator_plus", "b.C.operator_plus")}
