"""Change detection between snapshots, and caches by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from canopy.functions.names import has_prefix
from canopy.session import cut


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def changes(old: DataFrame, new: DataFrame, keys: list[str], value: str = "sha256", force: bool = False) -> DataFrame:
    """(keys, `status`): unchanged, changed, new or deleted. With `force` the old state counts as empty, so all is new."""
    if force:
        return new.select(*keys).withColumn("status", F.lit("new"))
    a = old.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_old"))
    b = new.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def without_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """The rows whose dotted name is neither the prefix nor below it."""
    return rows.where(~has_prefix(F.col(column), prefix))


def replace_by_file(old: DataFrame, new: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Facts after an update: those of changed or deleted files go, the new ones come."""
    return old.join(changed.where("status in ('changed', 'deleted', 'new')").select(*keys), keys, "left_anti").unionByName(new)


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """Rows of `wanted` with the cached columns, and the rows the cache doesn't have; of repeated entries any one serves."""
    entries = cache.where(F.col(key).isNotNull()).dropDuplicates([key])
    return wanted.join(entries, key), wanted.join(entries, key, "left_anti")


def duplicates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(`sha256`, `n`, `first`): contents that occur more than once."""
    return rows.where(F.col(text).isNotNull()).groupBy(content_hash(F.col(text)).alias("sha256")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


STATE = "project string, path string, sha256 string"


def save_state(state: DataFrame, where: str) -> None:
    """Writes (`project`, `path`, `sha256`) to a folder of its own below `where`, which becomes the latest."""
    state.select("project", "path", "sha256").write.mode("overwrite").parquet(where)


def load_state(spark: SparkSession, where: str) -> DataFrame:
    """The saved state; an absent or unreadable one is empty, so that all files count as new."""
    try:
        state = spark.read.parquet(where).select("project", "path", "sha256")
        state.limit(1).count()
    except Exception as e:  # noqa: BLE001
        if not isinstance(e, AnalysisException) and "arquet" not in str(e) and "FileNotFound" not in str(e):
            raise
        return spark.createDataFrame([], STATE)
    return state


def update(facts: DataFrame, state: DataFrame, files: DataFrame, extract: Callable[[DataFrame], DataFrame], force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, state, changes) after an update to `files` (`project`, `path`, `content`), equal to those of a full rebuild.

    Only new and changed files are parsed by `extract`; the facts (with `project`, `path`) of changed and deleted files go.
    What is resolved across files follows from the facts of all of them, so it is joined anew. With `force` everything is
    parsed again, and the facts of files that are no longer there stay, until they are pruned.
    """
    now = files.select("project", "path", content_hash(F.col("content")).alias("sha256"))
    status = cut(changes(state, now, ["project", "path"], force=force))
    dirty = status.where("status in ('new', 'changed')").select("project", "path")
    parsed = extract(files.join(dirty, ["project", "path"], "left_semi"))
    return cut(replace_by_file(facts, parsed, status, ["project", "path"])), now, status


def reconcile(expected: DataFrame, stored: DataFrame, key: str, sample: int = 10) -> DataFrame:
    """(`n_expected`, `n_missing`, `sample`): how many expected keys are not stored, and the first of them in order."""
    wanted = expected.select(key).distinct()
    missing = cut(wanted.join(stored.select(key), key, "left_anti"))
    first = missing.orderBy(key).limit(sample).agg(F.sort_array(F.collect_list(key)).alias("sample"))
    counts = wanted.agg(F.count("*").alias("n_expected")).join(missing.agg(F.count("*").alias("n_missing")))  # one row each
    return counts.join(first)
