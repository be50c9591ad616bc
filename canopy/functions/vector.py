"""Vector expressions, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; null if one is null or all zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(vectors: DataFrame, key: str, vector: str, wanted: list[float], k: int = 5) -> DataFrame:
    """(`key`, `score`) of the `k` rows most similar to one vector, by falling score and then by key."""
    query = F.array(*(F.lit(float(x)) for x in wanted))
    scored = vectors.where(F.size(vector) == len(wanted)).select(key, cosine(F.col(vector), query).alias("score"))
    return scored.where("score is not null and not isnan(score)").orderBy(F.desc("score"), F.asc(key)).limit(k)


def mean_pool(vectors: DataFrame, keys: list[str], vector: str, used: str) -> DataFrame:
    """(keys, `pooled`): mean of the vectors (arrays of equal length) of each group whose row is `used`; groups without any are left out.

    Coordinates are summed apart, so a group of any size is added up in part before it is shuffled.
    """
    each = vectors.where(F.col(used) & F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("at", "x"))
    means = each.groupBy(*keys, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("pooled"))
