"""Ranges between edges, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_of(x: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending edges are at most ``x``, by bisection: an expression as deep as the logarithm of their number."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x < F.lit(float(edges[middle])), between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(edges))
