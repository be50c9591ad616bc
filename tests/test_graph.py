import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canopy import queries_graph, schema
from canopy.graph import Graph
from canopy.operators import mutate, traverse
from canopy.plans.cypher import Unsupported, read_only
from canopy.sources import repository


@pytest.fixture(scope="module")
def golden(spark):
    nodes = [(1, ["Function"], {"name": "foo", "qualified_name": "mod.foo"}), (2, ["Function"], {"name": "bar", "qualified_name": "mod.bar"}), (3, ["Class"], {"name": "MyClass", "qualified_name": "mod.MyClass"}), (4, ["Module"], {"name": "mod", "qualified_name": "mod", "path": "mod.py"})]
    edges = [(1, 4, 1, "DEFINES", {}), (2, 4, 2, "DEFINES", {}), (3, 4, 3, "DEFINES", {}), (4, 1, 2, "CALLS", {"line": "10"})]
    return Graph(spark.createDataFrame([(*n, None) for n in nodes], schema.NODES), spark.createDataFrame(edges, schema.EDGES))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_reads(golden):
    assert rows(golden.cypher("MATCH (m:Module)-[:DEFINES]->(n:Function) RETURN n.name AS name ORDER BY n.name")) == [("bar",), ("foo",)]
    assert rows(golden.cypher("MATCH (f:Function) OPTIONAL MATCH (f)-[r:CALLS]->(g) RETURN f.name AS f, g.name AS g, r.line AS line ORDER BY f.name")) == [("bar", None, None), ("foo", "bar", "10")]
    assert rows(golden.cypher("MATCH (n) WHERE n.path IS NULL AND NOT n:Class RETURN count(n) AS n")) == [(2,)]
    assert rows(golden.cypher("MATCH (n) RETURN labels(n)[0] AS label, count(*) AS count ORDER BY count DESC LIMIT 1")) == [("Function", 2)]
    assert rows(golden.cypher("MATCH (n {name: $name}) RETURN id(n) AS id", name="foo")) == [(1,)]
    assert rows(golden.cypher("MATCH (m:Module)-[*]->(n) RETURN count(n) AS n")) == [(3,)]
    assert rows(golden.cypher("MATCH (f {name: 'bar'})-[*0..1]-(n) RETURN id(n) AS id ORDER BY id(n)")) == [(1,), (2,), (4,)]
    assert rows(golden.cypher("MATCH (m:Module)-[a:DEFINES]->(x), (m)-[b:DEFINES]->(y) RETURN count(*) AS n")) == [(6,)]
    assert rows(golden.cypher("MATCH (n:Function) WITH n, n.name AS name WHERE name STARTS WITH 'f' RETURN n.qualified_name AS qn")) == [("mod.foo",)]
    assert rows(golden.cypher("MATCH (n) WHERE ANY(l IN labels(n) WHERE l = 'Class') RETURN n.name AS name")) == [("MyClass",)]
    assert rows(golden.cypher("MATCH (n) RETURN n.path AS path ORDER BY n.path LIMIT 1")) == [("mod.py",)]
    assert rows(golden.cypher("MATCH (n) RETURN n.path AS path ORDER BY n.path DESC LIMIT 1")) == [(None,)]
    assert golden.cypher("MATCH (c:Class) RETURN c").first()[0]["node_id"] == 3


@pytest.mark.parametrize("text", ["MATCH (n) DELETE n", "match (n) set n.x = 1", "CALL db.x()", "LOAD /* x */ CSV FROM 'y'", "MATCH (n) WHERE n.name = 'DROP' RETURN n", "CREATE (n)", "MATCH (n) REMOVE n.x", "MERGE (n:X)", "FOREACH (x IN y | z)"])
def test_writes_are_refused(text):
    with pytest.raises(Unsupported):
        read_only(text)


@pytest.mark.parametrize("text", ["MATCH (n) WHERE n.name = 'DATASET' RETURN n", "MATCH (n) WHERE n.created_at > 3 RETURN n", "MATCH (n) OPTIONAL MATCH (n)-[]->(m) RETURN m", "MATCH (n) WHERE n.x = 'RESET' RETURN n"])
def test_reads_are_allowed(text):
    read_only(text)


@pytest.mark.parametrize("text", ["MATCH (a), (b) RETURN a", "MATCH (n)", "RETURN shout(1) AS x", "MATCH (n) RETURN n ORDER", "MATCH (a)-[*3..5]->(b) RETURN a.name AS a", "MATCH (n) RETURN n.name UNION MATCH (m) RETURN m.name"])
def test_beyond_the_subset(golden, text):
    with pytest.raises((Unsupported, Exception)):
        golden.cypher(text).collect()


def test_summary_and_lookups(golden, spark):
    assert set(rows(golden.summary())) == {("label", "Function", 2), ("label", "Class", 1), ("label", "Module", 1), ("type", "DEFINES", 3), ("type", "CALLS", 1)}
    assert rows(golden.by_property("name", "foo").select("node_id")) == [(1,)]
    one = spark.createDataFrame([(1,)], "id bigint")
    assert sorted(rows(golden.relationships(one).select("rel_id", "direction"))) == [(1, "incoming"), (4, "outgoing")]


def test_json_document_of_lines(golden, spark, monkeypatch):
    """The document doesn't pass through one row, and is the same."""
    whole = json.loads(repository.export_document(golden).first()[0])
    lines = [r.line for r in repository.document_lines(golden).collect()]
    assert json.loads("\n".join(lines)) == whole and sum("node_id" in x for x in lines) == len(whole["nodes"])
    assert max(x.count("from_id") + x.count("node_id") for x in lines) == 1
    none = [r.line for r in repository.document_lines(Graph(golden.nodes.limit(0), golden.edges.limit(0))).collect()]
    assert json.loads("".join(none)) == {"nodes": [], "relationships": [], "metadata": {"total_nodes": 0, "total_relationships": 0}}
    monkeypatch.delattr(repository, "export_document")
    monkeypatch.setattr(Graph, "from_tables", lambda spark, d: golden)
    assert rows(queries_graph.json_export_counts(spark, "")) == [(4, 4, 4)]


def test_json_round_trip(golden, spark, tmp_path):
    path = tmp_path / "graph.json"
    path.write_text(repository.export_document(golden).first()[0])
    back = repository.load_graph(spark, str(path))
    assert sorted(rows(back.edges.select("from_id", "to_id", "type"))) == sorted(rows(golden.edges.select("from_id", "to_id", "type")))
    assert back.by_property("name", "bar").count() == 1
    repository.save_tables(golden, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/nodes")).where("label = 'Function'").count() == 2
    repository.save_tables(golden, str(tmp_path / "j"), split=False)
    assert spark.read.parquet(str(tmp_path / "j/graph")).count() == 8


STAGE = "label string, key string, property string, value string, seq bigint"


def test_merge_last_wins_and_null_removes(golden, spark):
    stage = [("Function", "mod.foo", "name", "old", 1), ("Function", "mod.foo", "name", "new", 2), ("Class", "mod.MyClass", "name", None, 3), ("Function", "mod.x", "name", "x", 1), ("Function", "mod.x", "qualified_name", "mod.x", 1), (None, "k", "p", "v", 1), ("Function", None, "p", "v", 1)]
    merged = mutate.merge_nodes(golden, spark.createDataFrame(stage, STAGE)).nodes
    got = {r.properties.get("qualified_name"): (r.node_id, r.properties.get("name")) for r in merged.collect()}
    assert got["mod.foo"] == (1, "new") and got["mod.MyClass"] == (3, None) and got["mod.bar"] == (2, "bar")
    assert got["mod.x"][1] == "x" and merged.count() == 5


EDGE = "from_label string, from_key string, type string, to_label string, to_key string, properties map<string,string>, seq bigint"


def test_edges_need_both_ends(golden, spark):
    stage = spark.createDataFrame(
        [("Function", "mod.foo", "CALLS", "Function", "mod.bar", {"line": "42"}, 1), ("Function", "mod.foo", "CALLS", "Function", "mod.bar", {"line": "43"}, 2), ("Function", "mod.foo", "CALLS", "Function", "gone", {}, 3), ("Class", "mod.foo", "CALLS", "Function", "mod.bar", {}, 4), ("Function", "mod.bar", "CALLS", "Function", "mod.foo", {}, 5)], EDGE
    )
    merged = mutate.merge_edges(golden, stage).edges.where("type = 'CALLS'")
    assert sorted((r.from_id, r.to_id, r.properties.get("line")) for r in merged.collect()) == [(1, 2, "43"), (2, 1, None)]
    assert mutate.create_edges(golden, stage).edges.where("type = 'CALLS'").count() == 4


def test_deletes(golden):
    assert mutate.delete_module(golden, "mod.py").nodes.count() == 0
    left = mutate.detach(golden, golden.labelled("Class").select(F.col("node_id").alias("id")))
    assert left.nodes.count() == 3 and left.edges.count() == 3
    assert mutate.delete_edges(golden, "CALLS").edges.count() == 3
    assert mutate.delete_all(golden, True).nodes.count() == 0
    with pytest.raises(ValueError):
        mutate.delete_all(golden, False)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25))
def test_reach_against_model(spark, edges):
    df = spark.createDataFrame(edges or [(0, 0)][:0], "src bigint, dst bigint")
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)

    def hops(s):
        seen, front, n = {}, {s}, 0
        while front:
            n += 1
            front = {b for a in front for b in up.get(a, ())} - set(seen)
            seen |= {x: n for x in front}
        return seen

    got = {(r.start, r.id): r.hops for r in traverse.reachable(df.select(F.col("src").alias("start")), df).collect()}
    assert got == {(s, x): n for s in up for x, n in hops(s).items()}


def test_nearest_hits_order(spark):
    # 1 inherits 2 then 3; 2 inherits 4; 3 and 4 have the method: 3 is nearer. 5 has a diamond, 6 a cycle.
    edges = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 4, 0), (5, 7, 0), (5, 8, 1), (7, 9, 0), (8, 9, 0), (6, 6, 0)], "src bigint, dst bigint, ord int")
    hits = spark.createDataFrame([(3, "m"), (4, "m"), (9, "m"), (6, "m"), (2, "k"), (3, "k")], "id bigint, name string")
    starts = spark.createDataFrame([(1, "m"), (1, "k"), (5, "m"), (6, "m"), (1, "none")], "start bigint, name string")
    assert {(r.start, r.name): (r.id, r.hops) for r in traverse.nearest_hits(starts, edges, hits).collect()} == {(1, "m"): (3, 1), (1, "k"): (2, 1), (5, "m"): (9, 2)}
    assert {(r.start): r.id for r in traverse.nearest_hits(starts.where("start = 6"), edges, hits, own=True).collect()} == {6: 6}


def test_writes_as_text(golden):
    batch = [{"id": "mod.foo", "props": {"name": "new", "is_exported": True}}, {"id": "mod.z", "props": {"name": "z"}}, {"id": None, "props": {}}]
    g, _ = golden.execute("UNWIND $batch AS row MERGE (n:Function {qualified_name: row.id}) SET n += row.props", batch=batch)
    assert {r.properties["qualified_name"]: r.properties["name"] for r in g.labelled("Function").collect()} == {"mod.foo": "new", "mod.bar": "bar", "mod.z": "z"}
    edges = [{"from_val": "mod.foo", "to_val": "mod.z", "props": {"line": 42}}, {"from_val": "mod.foo", "to_val": "nowhere", "props": {}}]
    text = "UNWIND $batch AS row MATCH (a:Function {qualified_name: row.from_val}), (b:Function {qualified_name: row.to_val}) MERGE (a)-[r:CALLS]->(b) SET r += row.props RETURN count(r) AS created"
    h, created = g.execute(text, batch=edges)
    assert created.first()[0] == 1 and h.edges.where("type = 'CALLS'").count() == 2
    h, _ = h.execute("UNWIND $batch AS row CREATE (n:Class {qualified_name: row.id})", batch=[{"id": "q"}])
    assert h.labelled("Class").count() == 2
    assert golden.execute("MATCH ()-[r:CALLS]->() DELETE r")[0].edges.count() == 3
    assert golden.execute("MATCH (n) DETACH DELETE n")[0].nodes.count() == 0
    assert golden.execute("MATCH (m:Module {path: $path})-[*0..]->(c) DETACH DELETE m, c", path="mod.py")[0].nodes.count() == 0
    left = golden.execute("MATCH (m:Module {name: 'mod'}) OPTIONAL MATCH (m)-[:DEFINES*]->(d:Class) DETACH DELETE m, d")[0]
    assert left.nodes.count() == 2 and left.edges.count() == 1
    for bad in ("MATCH (m:Module) DELETE m", "MATCH (n) SET n.x = 1", "MATCH (n) RETURN n"):
        with pytest.raises(Unsupported):
            golden.execute(bad)


def test_find(golden, spark):
    got = golden.find(spark.createDataFrame([("mod.bar",), ("none",)], "qualified_name string")).collect()
    assert [(r.node_id, r.path, r.module_id, r.hops) for r in got] == [(2, "mod.py", 4, 1)]
    text = "MATCH (n) WHERE n.qualified_name = $qn OPTIONAL MATCH (m:Module)-[*]-(n) RETURN n.name AS name, m.path AS path LIMIT 1"
    assert rows(golden.cypher(text, qn="mod.bar")) == [("bar", "mod.py")]


def test_list_properties(spark):
    nodes = spark.createDataFrame([(1, ["Function"], {"name": "a", "decorators": '["@Task", "@flow"]'}, "p"), (2, ["Method"], {"name": "b", "decorators": "[]"}, "p"), (3, ["Function"], {"name": "c", "decorators": "no list"}, "p"), (4, ["Function"], {"name": "d"}, "p")], schema.NODES)
    g = Graph(nodes, spark.createDataFrame([], schema.EDGES))
    assert [r.name for r in g.cypher("MATCH (n:Function|Method) WHERE ANY(d IN n.decorators WHERE toLower(d) IN ['@flow', '@task']) RETURN n.name AS name").collect()] == ["a"]
    assert [r.name for r in g.cypher("MATCH (n:Function) WHERE '@Task' IN n.decorators RETURN n.name AS name").collect()] == ["a"]
    assert g.cypher("MATCH (n:Function) WHERE 'Task' IN n.decorators RETURN n.name AS name").count() == 0


def test_nearest_sources(spark):
    steps = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (9, 3), (3, 9), (5, 5), (None, 1)], "src bigint, dst bigint")
    found = traverse.nearest_sources(spark.createDataFrame([(1,), (9,), (None,), (9,)], "id bigint"), steps)
    assert {tuple(r) for r in found.select("id", "source", "hops").collect()} == {(1, 1, 0), (9, 9, 0), (2, 1, 1), (3, 9, 1)}
