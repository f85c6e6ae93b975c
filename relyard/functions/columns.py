"""Column helpers that shape how often an expression runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions run once per row.

    A plain ``withColumn`` lets the optimizer copy an expression into every later filter and use of the
    column; for JSON parsing, hashing and scoring that multiplies the work. Unfolding a one-element
    array keeps the value where it was computed.
    """
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))
