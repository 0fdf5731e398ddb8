"""Maths on ``array<float>`` columns and per-dimension aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NULL when either vector has no length."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """Unit vector; a zero vector stays zero. The length is worked out once a vector, not once an element."""
    scaled = lambda length: F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(
        F.transform(a, lambda x: x.cast("double"))
    )
    return F.get(F.transform(F.array(norm(a)), scaled), 0)


def by_dimension(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """One row per (row, dimension); averages over it combine before the shuffle."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "x")).withColumn(
        "x", F.col("x").cast("double")
    )


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """Mean vector per group: partial sums per dimension, then one short array per group."""
    per_dim = by_dimension(df, keys, vector).groupBy(*keys, "dim").agg(F.avg("x").alias("m"))
    return per_dim.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias(out)
    )
