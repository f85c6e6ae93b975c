"""Logistic regression over whole tables and per segment, and scoring with models held as data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from relyard import constants as c
from relyard.functions.scoring import decision_value, sigmoid, standardise
from relyard.operators.ordered import lookup_join
from relyard.session import shared_root


def train_logreg(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Balanced, L2-regularised logistic regression (C = 1) on standardised features.

    Returns the model as data: position, feature, mean, std, coef, intercept. Balanced weights sum to
    the row count, hence the penalty 1/n in Spark's averaged objective.
    """
    # The fit runs right here, so the fitted values may as well be plain numbers: one row per feature
    # and one per class come back to the driver, which LogisticRegression does with its coefficients too.
    # One pass gives them all.
    ones, zeros = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    moments = [x for f in features for x in (F.avg(F.col(f"`{f}`")), F.stddev_pop(F.col(f"`{f}`")))]
    n, n1, n0, *fitted_moments = train.agg(F.count(F.lit(1)), ones, zeros, *moments).first()
    if n1 + n0 != n or not n1 or not n0:
        raise ValueError(f"labels must be 0 and 1: of {n} rows {n0} are 0 and {n1} are 1")
    scaler = {f: {"mean": fitted_moments[2 * i], "std": fitted_moments[2 * i + 1]} for i, f in enumerate(features)}
    weights = {1: n / (2 * n1), 0: n / (2 * n0)}
    scaled = train.select(
        label,
        F.when(F.col(label) == 1, weights[1]).otherwise(weights[0]).alias("weight"),
        *[standardise(F.col(f), F.lit(scaler[f]["mean"]), F.lit(scaler[f]["std"])).alias(f) for f in features],
    )
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(scaled)
    fitted = LogisticRegression(
        labelCol=label,
        weightCol="weight",
        maxIter=c.MAX_ITER,
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-9,
    ).fit(assembled.select("features", label, "weight"))
    rows = [
        (i, f, scaler[f]["mean"], scaler[f]["std"], float(w), float(fitted.intercept))
        for i, (f, w) in enumerate(zip(features, fitted.coefficients))
    ]
    return train.sparkSession.createDataFrame(
        rows, "feature_pos int, feature string, mean double, std double, coef double, intercept double"
    )


def score_columns(df: DataFrame, model: Column, features: Sequence[str]) -> DataFrame:
    """Add ``score`` = P(class 1) from plain feature columns and a model struct."""
    row = F.create_map(*[part for f in features for part in (F.lit(f), F.col(f).cast("double"))])
    return df.withColumn("score", sigmoid(decision_value(model, row)))


def predictor_udf(model: Any):
    """Score with any object that has ``predict(DataFrame) -> sequence of float``.

    The object reaches each worker once and sees Arrow batches; use it only for models that cannot be
    written as a column expression. Call the result on one struct column of the features.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.asarray(model.predict(batch), dtype=float))

    return score


def _solver():
    @F.pandas_udf("array<double>")
    def newton_step(beta: pd.Series, gradient: pd.Series, hessian: pd.Series) -> pd.Series:
        def one(b, g, h):
            size = len(b)
            matrix = np.zeros((size, size))
            matrix[np.triu_indices(size)] = h
            matrix = matrix + np.triu(matrix, 1).T
            ridge = np.eye(size)
            ridge[0, 0] = 0.0  # the intercept is not penalised
            step = np.linalg.solve(matrix + ridge, np.asarray(g) - ridge @ np.asarray(b))
            return (np.asarray(b) + step).tolist()

        return pd.Series([one(b, g, h) for b, g, h in zip(beta, gradient, hessian)])

    return newton_step


def train_per_segment(
    df: DataFrame,
    segment: str,
    features: Sequence[str],
    label: str,
    max_steps: int = c.MAX_ITER,
    tolerance: float = 1e-9,
) -> DataFrame:
    """The same regression for every segment at once, by Newton steps made of grouped sums.

    A segment is never gathered in one task: each step aggregates gradient and curvature with
    map-side partial sums, so a segment with a third of all rows costs no more than its rows. Only one
    small row per segment meets numpy. Coefficients are checkpointed after each step, which keeps the
    plan short and survives lost executors.

    Every segment has a row: coefficients, ``steps`` taken and whether it ``converged`` within ``max_steps``. A segment that
    cannot be fitted has null coefficients and a ``reason`` ('one class', 'null label' or 'null feature'). A segment that has
    converged takes no further step.
    """
    shared_root(df.sparkSession)

    gap = reduce(lambda a, b: a | b, [F.col(f"`{f}`").isNull() for f in features])
    everything = df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("n1"),
        F.count_if(F.col(label).isNull()).alias("_unlabelled"),
        F.count_if(gap).alias("_gaps"),
        *[F.avg(F.col(f"`{f}`")).alias(f"mean_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"std_{f}") for f in features],
    )
    reason = (
        F.when(F.col("_unlabelled") > 0, F.lit("null label"))
        .when(F.col("_gaps") > 0, F.lit("null feature"))
        .when((F.col("n1") == 0) | (F.col("n1") == F.col("n")), F.lit("one class"))
    )
    everything = everything.withColumn("reason", reason).checkpoint()
    fitted = everything.filter(F.col("reason").isNull())
    stats = F.struct("n", "n1", *[f"mean_{f}" for f in features], *[f"std_{f}" for f in features])
    known = lookup_join(
        df.select(segment, label, *features), fitted.select(segment, stats.alias("_fit")), [segment], features, how="inner"
    )
    scaled = [
        (F.col(f) - F.col(f"_fit.mean_{f}")) / F.when(F.col(f"_fit.std_{f}") == 0, 1.0).otherwise(F.col(f"_fit.std_{f}"))
        for f in features
    ]
    of_class = F.when(F.col(label) == 1, F.col("_fit.n1")).otherwise(F.col("_fit.n") - F.col("_fit.n1"))
    rows = known.select(
        segment,
        F.col(label).cast("double").alias("_y"),
        (F.col("_fit.n") / (2.0 * of_class)).alias("_w"),
        *[x.alias(f) for x, f in zip(scaled, features)],
    ).persist(StorageLevel.MEMORY_AND_DISK)

    inputs = [F.lit(1.0), *[F.col(f) for f in features]]
    size = len(inputs)
    zeros = F.array(*[F.lit(0.0)] * size)
    betas = fitted.select(segment, zeros.alias("beta"), F.lit(0).alias("steps"), F.lit(False).alias("converged"))
    step = _solver()
    for _ in range(max_steps):
        moving = betas.filter(~F.col("converged"))
        scored = lookup_join(rows, moving.select(segment, F.col("beta").alias("_beta")), [segment], features, how="inner")
        z = sum((F.col("_beta")[i] * inputs[i] for i in range(1, size)), F.col("_beta")[0])
        scored = scored.withColumn("_p", sigmoid(z))
        residual = F.col("_w") * (F.col("_y") - F.col("_p"))
        curve = F.col("_w") * F.col("_p") * (F.lit(1.0) - F.col("_p"))
        gradient = [F.sum(residual * inputs[i]) for i in range(size)]
        hessian = [F.sum(curve * inputs[i] * inputs[j]) for i in range(size) for j in range(i, size)]
        sums = scored.groupBy(segment).agg(F.array(*gradient).alias("g"), F.array(*hessian).alias("h"))
        moved = moving.join(sums, segment).select(
            segment, F.col("beta").alias("old"), step("beta", "g", "h").alias("beta"), (F.col("steps") + 1).alias("steps")
        )
        change = F.array_max(F.zip_with("old", "beta", lambda a, b: F.abs(a - b)))
        moved = moved.select(segment, "beta", "steps", (change < tolerance).alias("converged"))
        betas = betas.filter("converged").unionByName(moved).checkpoint()
        if betas.filter(~F.col("converged")).isEmpty():
            break
    rows.unpersist()
    return everything.select(segment, "reason").join(betas, segment, "left").select(
        segment,
        F.get("beta", F.lit(0)).alias("intercept"),
        *[F.get("beta", F.lit(i + 1)).alias(f"coef_{f}") for i, f in enumerate(features)],
        "steps",
        F.coalesce("converged", F.lit(False)).alias("converged"),
        "reason",
    )
