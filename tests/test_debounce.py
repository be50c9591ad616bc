import datetime as dt
import time

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from canopy.streaming import debounce as D

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "path string, ts timestamp, event_type string, is_directory boolean"


def model(events, debounce, cap):
    out = []
    for path in {p for p, *_ in events}:
        first = last = kind = None
        n = 0
        for t, k in sorted((t, k) for p, t, k in events if p == path):
            if first is not None and t >= min(last + debounce, first + cap):
                out.append((path, min(last + debounce, first + cap), kind, n))
                first, n = None, 0
            first = t if first is None else first
            last, kind, n = t, k, n + 1
        out.append((path, min(last + debounce, first + cap), kind, n))
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.sampled_from(["created", "modified", "opened"])), min_size=1, max_size=25))
def test_batch_against_model(spark, events):
    rows = spark.createDataFrame([(p, T0 + dt.timedelta(seconds=t), k, False) for p, t, k in events], SCHEMA)
    got = sorted((r.path, int((r.fired_at - T0).total_seconds()), r.event_type, r.n_events) for r in D.debounce_batch(rows, 5, 12).collect())
    assert got == model(events, 5, 12)


def test_cap_and_order(spark):
    at = lambda s, p="a", k="modified": (p, T0 + dt.timedelta(seconds=s), k, False)
    rows = spark.createDataFrame([at(0), at(4), at(8), at(12), at(13, k="opened"), at(40)], SCHEMA)
    fired = D.debounce_batch(rows, 5, 12)
    assert [(int((r.fired_at - T0).total_seconds()), r.n_events, r.event_type) for r in fired.orderBy("fired_at").collect()] == [(12, 3, "modified"), (18, 2, "opened"), (45, 1, "modified")]
    assert D.acted_on(fired).count() == 2
    assert D.debounce_batch(rows, 0, 0).count() == 6
    assert D.debounce_batch(rows, 5, 1).count() == D.debounce_batch(rows, 5, 5).count()
    assert D.debounce_batch(rows.limit(0), 5, 12).count() == 0


def test_relevant(spark):
    rows = spark.createDataFrame([("src/a.py", T0, "modified", False), ("src", T0, "modified", True), ("node_modules/a.js", T0, "modified", False), ("a.pyc", T0, "created", False)], SCHEMA)
    assert [r.path for r in D.relevant(rows).collect()] == ["src/a.py"]


def test_stream(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    kind = "path string, ts timestamp, event_type string"
    stream = spark.readStream.schema(kind).parquet(str(source))
    query = D.debounce_stream(stream, 1, 6).writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend(df.collect())).trigger(processingTime="300 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        frame = pd.DataFrame({"path": ["a", "a", "b"], "ts": pd.to_datetime([T0, T0 + dt.timedelta(seconds=1), T0]).tz_localize("UTC").astype("datetime64[us, UTC]"), "event_type": ["created", "modified", "deleted"]})
        frame.to_parquet(source / "1.parquet", index=False)
        end = time.time() + 60
        while len(seen) < 2 and time.time() < end:
            time.sleep(0.3)
    finally:
        query.stop()
    assert sorted((r.path, r.event_type, r.n_events) for r in seen) == [("a", "modified", 2), ("b", "deleted", 1)]
