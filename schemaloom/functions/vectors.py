"""Column expressions over vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalise(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    own = doubles(v)
    length = norm(v)
    return F.when(length > 0, F.transform(own, lambda x: x / length)).otherwise(own)


def mean_pool(rows: DataFrame, keys: list[str], vector: str, mask: Column | None = None) -> DataFrame:
    """The mean vector of each key over the rows whose mask is 1; the divisor is at least 1e-9."""
    weight = F.lit(1.0) if mask is None else mask.cast("double")
    each = rows.select(*keys, weight.alias("w"), F.posexplode(doubles(F.col(vector))).alias("i", "x"))
    pooled = each.groupBy(*keys, "i").agg((F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return pooled.groupBy(*keys).agg(F.transform(ordered, lambda p: p["x"]).alias(vector))
