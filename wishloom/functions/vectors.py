"""Vector expressions and centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind, tokens


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; unequal lengths raise."""
    value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("Vectors must have the same length"))
    )


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector is unchanged."""
    length = norm(v)
    return F.when(length == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / length))


def centroids(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per key and whether its vectors all had one length.

    Averages run per (key, position), so a key that owns most rows is still
    combined map-side; only `dimension` values per key are ever collected.
    """
    flat = df.select(key, F.size(vector).alias("_d"), F.posexplode(vector).alias("_p", "_x"))
    per_position = flat.groupBy(key, "_p").agg(
        F.avg(F.col("_x").cast("double")).alias("_m"),
        F.min("_d").alias("_lo"), F.max("_d").alias("_hi"), F.count(F.lit(1)).alias("_n"),
    )
    return per_position.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("centroid"),
        F.max("_n").alias("n_vectors"),
        (F.min("_lo") == F.max("_hi")).alias("consistent"),
    )


def hashed_bag_of_words(text: Column, dimension: int = 64) -> Column:
    """Deterministic stand-in for an embedding provider, natively computed; every word is hashed once."""
    slots = F.transform(tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dimension)
    return bind(slots, lambda s: F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: (F.array_size(s) - F.array_size(F.array_remove(s, i.cast("long")))).cast("double"),
    ))
