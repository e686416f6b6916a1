"""Helpers to build expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for an expression that uses it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)
