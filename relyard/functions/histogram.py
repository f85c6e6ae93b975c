"""Bucket expressions for fixed-bound histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def bucket_index(value: Column, bounds: Sequence[float]) -> Column:
    """0-based index of the first bound that is >= value."""
    expr = None
    for i, bound in enumerate(bounds[:-1]):
        test = value <= F.lit(float(bound))
        expr = F.when(test, F.lit(i)) if expr is None else expr.when(test, F.lit(i))
    return expr.otherwise(F.lit(len(bounds) - 1))


def bound_label(bound: float) -> str:
    return "+Inf" if bound == float("inf") else repr(float(bound))


def cumulative_counts(bounds: Sequence[float], index: str = "bucket", count: str = "n") -> Column:
    """Aggregate: array of (pos, le, cumulative_count) over per-bucket counts; empty buckets included."""
    entries = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(bound_label(b)).alias("le"),
            F.sum(F.when(F.col(index) <= i, F.col(count)).otherwise(F.lit(0))).alias("cumulative_count"),
        )
        for i, b in enumerate(bounds)
    ]
    return F.array(*entries)
