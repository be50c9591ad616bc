"""Session helpers: table reading and cutting of lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only where that is unset and all runs in one process (a local master, as in tests) a folder of our own is made; on a
    cluster other executors could not see such a folder, so there the session has to name one.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    where = configured or tempfile.mkdtemp(prefix="canopy-checkpoint-")
    sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read from there: its lineage ends, and a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`cut`, and the number of rows, which is observed while they are written."""
    seen = Observation()
    return cut(df.observe(seen, F.count(F.lit(1)).alias("n"))), seen.get["n"]


#: Rows of a few numbers that are broadcast at most; about 10 MB.
SMALL = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, to be broadcast if its counted `rows` are few; beyond that Spark joins it by shuffling."""
    return F.broadcast(df) if rows <= SMALL else df
