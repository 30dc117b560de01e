"""Embeddings as ARRAY<FLOAT> columns: products, norms, normalised means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Cosine similarity of vectors that are normalised already."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v)


def is_valid(v: Column) -> Column:
    """Not null, not empty, every entry finite.  A zero vector is valid."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def mean_embedding(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """One normalised mean vector a group.

    Means are taken per position, so partial sums are combined before the exchange
    and no task holds a group's vectors.
    """
    each = rows.select(*keys, F.posexplode(vector).alias("__pos", "__x"))
    means = each.groupBy(*keys, "__pos").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    whole = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__pos", "__m"))).alias("__v"))
    return whole.select(*keys, normalized(F.transform("__v", lambda s: s["__m"]).cast("array<double>")).cast("array<float>").alias(vector))
