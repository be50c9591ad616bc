import datetime as dt

from canopy.operators import orphans as O

DAY = lambda n: dt.datetime(2025, 1, n)
RECORD = "id bigint, created_at timestamp, deleted_at timestamp"


def test_reasons(spark):
    records = spark.createDataFrame(
        [(1, DAY(2), None), (1, DAY(2), None), (2, DAY(2), DAY(4)), (2, DAY(6), None), (3, DAY(9), None), (4, None, None), (None, DAY(1), None), (5, DAY(5), DAY(5)), (6, DAY(2), DAY(5)), (6, DAY(4), DAY(8)), (6, DAY(3), DAY(4))], RECORD
    )
    asked = [(1, 1, 2), (2, 1, 1), (3, 2, 3), (4, 2, 4), (5, 2, 5), (6, 2, 6), (7, 3, 8), (8, 4, 8), (9, 99, 8), (10, None, 8), (11, 5, 5), (12, 6, 7), (13, 6, 8), (14, 6, 4)]
    refs = spark.createDataFrame([(a, b, DAY(c)) for a, b, c in asked], "rel_id bigint, key bigint, at timestamp")
    got = {r.rel_id: r.reason for r in O.direct_orphans(refs, records).collect()}
    assert got == {2: "late", 4: "deleted", 5: "deleted", 7: "late", 8: "deleted", 9: "missing", 11: "deleted", 13: "deleted"}


def test_hot_ids(spark, monkeypatch):
    records = spark.createDataFrame([(1, DAY(2), DAY(5)), (2, DAY(2), None)], RECORD)
    refs = spark.createDataFrame([(i, 1 + (i % 4 == 0), DAY(1 + i % 8)) for i in range(40)] + [(99, 3, DAY(1))], "rel_id bigint, key bigint, at timestamp")
    want = {tuple(r) for r in O.direct_orphans(refs, records).collect()}
    assert O.hot_keys(refs) is None and [r.key for r in O.hot_keys(refs, 2, 5).collect()] == [1]
    monkeypatch.setattr(O, "hot_keys", lambda r: r.where("key = 1").select("key").distinct())
    assert {tuple(r) for r in O.direct_orphans(refs, records).collect()} == want


def test_empty(spark):
    refs = spark.createDataFrame([(1, 1, DAY(1))], "rel_id bigint, key bigint, at timestamp")
    none = spark.createDataFrame([], RECORD)
    assert [r.reason for r in O.direct_orphans(refs, none).collect()] == ["missing"]
    assert O.direct_orphans(refs.limit(0), none).count() == 0


def test_cascade_ends_on_cycles(spark):
    links = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("a", 2, 3), ("a", 4, 3), ("b", 5, 2), ("a", None, 1)], "hierarchy string, child bigint, parent bigint")
    start = spark.createDataFrame([("a", 2), ("a", 2), ("a", None)], "hierarchy string, node_id bigint")
    assert {(r.node_id, r.level) for r in O.orphan_cascade(links, start).collect()} == {(2, 0), (3, 1), (4, 2)}
    assert O.orphan_cascade(links, start.limit(0)).count() == 0
