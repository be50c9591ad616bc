import glob
import os

import pytest

import __spark_entry__ as entry
from verify import rows

D = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
@pytest.mark.parametrize("name", ["p1_found", "p1_paths", "p1_descendants", "p4_found", "p4_report", "p4_cascade", "expand_two_hop", "optional_match", "merge_edges_requires_endpoints", "inherited_method", "best_candidate", "debounce_batch", "directory_structure"])
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = entry.queries()[name](spark, D)
    got = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
