"""Debouncing of file events, in batch and in streams.

Every event of a path arms its timer anew; the timer fires `debounce` seconds after the last event, but no later than
`max_wait` after the first. The last event is what fires. The next event after that opens a new round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.paths import should_skip

ACTED_ON = ["modified", "created", "deleted"]


def relevant(events: DataFrame, path: str = "path") -> DataFrame:
    """Events of files that a scan wouldn't skip."""
    rows = events.where("not coalesce(is_directory, false)") if "is_directory" in events.columns else events
    return rows.where(~should_skip(F.col(path)))


def _checked(debounce: float, max_wait: float) -> tuple[float, float]:
    if debounce < 0:
        raise ValueError("debounce must not be negative")
    return debounce, max(debounce, max_wait)


def debounce_batch(events: DataFrame, debounce: float, max_wait: float, path: str = "path", ts: str = "ts", kind: str = "event_type", tie: str | None = None) -> DataFrame:
    """(`path`, `fired_at`, `event_type`, `n_events`, `first_at`): what fires when all events have happened.

    The cap makes this a fold over each path's events in order, done in the JVM on a sorted array; of events at one time
    the one with the greater `tie` (or kind) is the last. Rows with a null path or time are left out. A path's events of
    one snapshot have to fit in memory; `debounce_stream` keeps only the open round.
    """
    debounce, max_wait = _checked(debounce, max_wait)
    if debounce == 0:
        return events.where(f"{path} is not null and {ts} is not null").select(path, F.col(ts).cast("timestamp").alias("fired_at"), kind, F.lit(1).cast("bigint").alias("n_events"), F.col(ts).cast("timestamp").alias("first_at"))
    second = F.unix_micros(F.col(ts).cast("timestamp"))
    d, w = int(debounce * 1e6), int(max_wait * 1e6)
    item = F.struct(second.alias("t"), F.col(tie or kind).alias("o"), F.col(kind).alias("k"))
    rounds = "array<struct<first:bigint,last:bigint,k:string,n:bigint>>"

    def step(done: Column, e: Column) -> Column:
        open_ = F.try_element_at(done, F.lit(-1))
        due = F.least(open_["last"] + d, open_["first"] + w)
        fresh = F.struct(e["t"].alias("first"), e["t"].alias("last"), e["k"].cast("string").alias("k"), F.lit(1).cast("bigint").alias("n"))
        more = F.struct(open_["first"].alias("first"), e["t"].alias("last"), e["k"].cast("string").alias("k"), (open_["n"] + 1).alias("n"))
        return F.when(open_.isNull() | (e["t"] >= due), F.concat(done, F.array(fresh))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(more)))

    grouped = events.where(f"{path} is not null and {ts} is not null").groupBy(path).agg(F.sort_array(F.collect_list(item)).alias("e"))
    folded = grouped.select(path, F.explode(F.aggregate("e", F.array().cast(rounds), step)).alias("r"))
    at = F.timestamp_micros(F.least(F.col("r.last") + d, F.col("r.first") + w))
    return folded.select(path, at.alias("fired_at"), F.col("r.k").alias(kind), F.col("r.n").alias("n_events"), F.timestamp_micros("r.first").alias("first_at"))


def debounce_stream(events: DataFrame, debounce: float, max_wait: float) -> DataFrame:
    """The same on a stream of (`path`, `ts`, `event_type`), by processing time: (`path`, `fired_at`, `event_type`, `n_events`).

    State per path is the open round only; its timer is the earlier of the two limits.
    """
    debounce, max_wait = _checked(debounce, max_wait)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        fire = lambda now, k, n: pd.DataFrame({"path": [key[0]], "fired_at": [pd.Timestamp(now, unit="ms", tz="UTC")], "event_type": [k], "n_events": [n]})
        if state.hasTimedOut:
            _, k, n = state.get
            state.remove()
            yield fire(state.getCurrentProcessingTimeMs(), k, n)
            return
        now = state.getCurrentProcessingTimeMs()
        first, k, n = state.get if state.exists else (now, "", 0)
        for frame in frames:
            frame = frame.sort_values("ts")
            n, k = n + len(frame), frame["event_type"].iloc[-1]
        wait = min(debounce * 1000, max_wait * 1000 - (now - first))
        if wait <= 0:
            if state.exists:
                state.remove()
            yield fire(now, k, n)
        else:
            state.update((first, k, n))
            state.setTimeoutDuration(max(1, int(wait)))

    return events.groupBy("path").applyInPandasWithState(run, "path string, fired_at timestamp, event_type string, n_events bigint", "first bigint, kind string, n bigint", "append", "ProcessingTimeTimeout")


def acted_on(fired: DataFrame) -> DataFrame:
    """Of what fired, what changes the graph. It is filtered after debouncing, so a last event of another kind cancels."""
    return fired.where(F.col("event_type").isin(ACTED_ON))
