"""Linear models held as data: one struct per version, scored with built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MODEL_TYPE = "struct<intercept: double, terms: array<struct<feature: string, mean: double, std: double, coef: double>>>"


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def standardise(value: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std with a constant column left unscaled."""
    return (value - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def decision_value(model: Column, row: Column) -> Column:
    """Intercept plus the weighted standardised features of one row map; null if a feature is missing."""
    return F.aggregate(
        model["terms"],
        model["intercept"],
        lambda acc, t: acc + t["coef"] * standardise(F.try_element_at(row, t["feature"]), t["mean"], t["std"]),
    )


def probabilities(model: Column, rows: Column) -> Column:
    """One probability per row of the request; null when there is no model."""
    scored = F.transform(rows, lambda row: sigmoid(decision_value(model, row)))
    return F.when(model.isNotNull(), scored)


def label_of(probability: Column, threshold: float) -> Column:
    return (probability >= F.lit(threshold)).cast("int")


def mean_abs_diff(left: Column, right: Column) -> Column:
    """Mean absolute difference over the shorter of both arrays; 0 for empty ones."""
    size = F.least(F.size(left), F.size(right))
    total = F.aggregate(
        F.zip_with(F.slice(left, F.lit(1), size), F.slice(right, F.lit(1), size), lambda a, b: F.abs(a - b)),
        F.lit(0.0),
        lambda acc, d: acc + d,
    )
    return F.when(left.isNotNull() & right.isNotNull(), total / F.greatest(size, F.lit(1)))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
