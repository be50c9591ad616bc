import random

import pytest

from canopy.operators import hierarchy as H

SCHEMA = "hierarchy string, child bigint, parent bigint"


def brute_cycles(edges):
    out = set()
    for h in {e[0] for e in edges}:
        up = {}
        for _, c, p in (e for e in edges if e[0] == h):
            up.setdefault(c, set()).add(p)
        nodes = set(up) | {p for ps in up.values() for p in ps}

        def reach(n):
            seen, todo = set(), [n]
            while todo:
                for p in up.get(todo.pop(), ()):
                    if p not in seen:
                        seen.add(p)
                        todo.append(p)
            return seen

        r = {n: reach(n) for n in nodes}
        out |= {(h, min([n] + [m for m in r[n] if n in r[m]]), n) for n in nodes if n in r[n]}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.choice("ab"), rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [("c", i + 1, i) for i in range(40)] + [("c", 20, 40), ("d", 5, 5)]
    edges += edges[:10]  # repeated rows
    found = {tuple(r) for r in H.find_cycles(spark.createDataFrame(edges, SCHEMA)).select("hierarchy", "cycle_id", "node_id").collect()}
    assert found == brute_cycles(edges)


def test_cycles_by_colour(spark):
    edges = [("a", 1, 2), ("a", 2, 3), ("a", 3, 1), ("a", 3, 4), ("a", 4, 5), ("a", 5, 4), ("a", 6, 1)]
    core = H.cyclic_core(spark.createDataFrame(edges, SCHEMA))
    assert {tuple(r) for r in H._components_by_colour(core).select("hierarchy", "cycle_id", "id").collect()} == brute_cycles(edges)


def test_core_without_doubling(spark, monkeypatch):
    edges = [("a", i + 1, i) for i in range(9)] + [("a", 3, 8)]
    assert H.cyclic_core(spark.createDataFrame(edges, SCHEMA), growth=-1_000_000).count() == 6


def test_nulls_empty_and_extra_columns(spark):
    rows = spark.createDataFrame([("a", None, 1, "x"), (None, 1, 1, "x"), ("a", 1, None, None), ("a", 2, 2, None)], SCHEMA + ", node_id string")
    assert [tuple(r) for r in H.find_cycles(rows).select("hierarchy", "cycle_id", "node_id").collect()] == [("a", 2, 2)]
    empty = spark.createDataFrame([], SCHEMA)
    assert H.find_cycles(empty).count() == 0
    assert H.hierarchy_report(H.resolve_paths(empty), H.all_descendants(empty)).count() == 0


def test_edges_of_relationships(spark):
    rows = spark.createDataFrame([(1, 2, " defines "), (2, 3, "INHERITS"), (3, None, "DEFINES"), (4, 5, None), (5, 6, "CALLS"), (1, 2, "DEFINES")], "from_id bigint, to_id bigint, type string")
    assert {tuple(r) for r in H.hierarchy_edges(rows).collect()} == {("containment", 2, 1), ("inheritance", 2, 3)}


def test_paths(spark):
    edges = [("a", i + 1, i) for i in range(20)] + [("a", 15, 3), ("a", 100, 101), ("a", 101, 100), ("a", 102, 101)]
    df = spark.createDataFrame(edges + [("a", 100, 99), ("a", 99, 98), ("b", 777, 777)], SCHEMA)
    got = {r.node_id: r for r in H.hierarchy_report(H.resolve_paths(df), H.all_descendants(df)).collect()}
    assert got[20].path == "0/1/2/3/15/16/17/18/19/20" and got[20].depth == 9 and got[20].root_id == 0
    assert got[14].depth == 14 and got[3].n_descendants == 17 and got[0].n_descendants == 20
    # What lies above a cycle stays reachable: the cycle stands in paths as its smallest id.
    assert got[100].in_cycle and got[101].in_cycle and got[101].path == "98/99/101" and got[101].n_descendants == 2 and not got[102].in_cycle
    assert got[102].path == "98/99/100/102" and got[102].root_id == 98 and got[98].n_descendants == 4
    assert got[777].in_cycle and got[777].path == "777" and got[777].n_descendants == 0


def brute_below(edges):
    out = {}
    for h in {e[0] for e in edges}:
        up = {}
        for _, c, p in (e for e in edges if e[0] == h):
            up.setdefault(c, set()).add(p)
        for n in up:
            level, seen, depth = {n}, {n}, 0
            while level:
                level, depth = {p for c in level for p in up.get(c, ())} - seen, depth + 1
                seen |= level
                out |= {(h, a, n): depth for a in level}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_descendants_and_roots_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.choice("ab"), rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [("c", i + 1, i) for i in range(40)] + [("c", 20, 40), ("c", 30, 2), ("d", 5, 5)]
    below, df = brute_below(edges), spark.createDataFrame(edges, SCHEMA)
    assert {tuple(r)[:3]: r.distance for r in H.all_descendants(df).collect()} == below
    nodes = {(e[0], n) for e in edges for n in e[1:]}
    top = {(h, n) for h, n in nodes if all((h, n, a) in below for g, a, m in below if (g, m) == (h, n))}
    roots = {(h, n) for h, n in top if not any((h, a, n) in below for g, a in top if g == h and a < n)}
    assert {tuple(r) for r in H.all_roots(df).collect()} == {(h, n, a) for h, a, n in below if (h, a) in roots} | {(h, n, n) for h, n in roots}


def test_all_descendants_through_every_parent_and_cycle(spark):
    edges = spark.createDataFrame([("a", 3, 1), ("a", 3, 2), ("a", 4, 3), ("a", 5, 4), ("a", 4, 5), ("a", 6, 5)], SCHEMA)
    got = {tuple(r)[1:3] for r in H.all_descendants(edges).collect()}
    assert got == {(a, n) for a in (1, 2) for n in (3, 4, 5, 6)} | {(3, 4), (3, 5), (3, 6), (4, 5), (4, 6), (5, 4), (5, 6)}
    assert {tuple(r)[1:] for r in H.all_roots(edges).collect()} == {(n, a) for n in (3, 4, 5, 6) for a in (1, 2)} | {(1, 1), (2, 2)}
