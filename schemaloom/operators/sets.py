"""Unions and distinct rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that a frame lacks is null there."""
    if not frames:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_lines(rows: DataFrame, line: str) -> DataFrame:
    return rows.select(line).where(F.col(line).isNotNull()).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b.select(a.columns)).distinct()


def joined_bins(*parts: str):
    """Array columns one after another; a null part is empty."""
    return F.concat(*[F.coalesce(p, F.array()) for p in parts])
