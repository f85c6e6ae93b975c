"""Scaler, class weights, feature statistics and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from relyard.functions.scoring import standardise


def feature_label_split(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(label), df.select(label)


def label_cast(label: Column) -> Column:
    """Whole-number label, truncating; a null label stops the job, as a cast to int does elsewhere."""
    whole = F.when(label >= 0, F.floor(label)).otherwise(F.ceil(label))
    return F.when(label.isNotNull(), whole.cast("int")).otherwise(F.raise_error(F.lit("null label")).cast("int"))


def _per_feature(
    df: DataFrame, group: Sequence[str], features: Sequence[str], aggregates: dict[str, str]
) -> DataFrame:
    """One pass over the wide rows: every aggregate per feature, then turned into one row per feature.

    ``aggregates`` maps an output name to a SQL aggregate of ``{x}``. Aggregating wide and unfolding the
    result keeps the scan at one row per input row.
    """
    wide = [
        F.expr(text.format(x=f"`{f}`")).alias(f"{name}__{f}") for f in features for name, text in aggregates.items()
    ]
    rows = [
        f"named_struct('feature', '{f}', " + ", ".join(f"'{name}', `{name}__{f}`" for name in aggregates) + ")"
        for f in features
    ]
    return df.groupBy(*group).agg(*wide).select(*group, F.expr(f"inline(array({', '.join(rows)}))"))


def fit_scaler(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per feature."""
    return _per_feature(train, [], features, {"mean": "avg({x})", "std": "stddev_pop({x})"})


def apply_scaler(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """Standardise with fitted values that reach the rows as a one-row scalar subquery."""
    wide = scaler.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("m"))
    fitted = wide.select(F.struct(*[F.col("m")[f].alias(f) for f in features]).alias("s")).scalar()
    known = F.col("_fitted")
    scaled = {f: standardise(F.col(f), known[f]["mean"], known[f]["std"]) for f in features}
    return df.withColumn("_fitted", fitted).withColumns(scaled).drop("_fitted")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    mean = counts.agg(F.avg("n_class")).scalar()
    return counts.withColumn("weight", mean / F.col("n_class"))


def feature_stats(df: DataFrame, group: Sequence[str], features: Sequence[str]) -> DataFrame:
    return _per_feature(
        df,
        group,
        features,
        {
            "count": "count({x})",
            "nulls": "count_if({x} IS NULL)",
            "mean": "round(avg({x}), 6)",
            "std": "round(stddev_pop({x}), 6)",
            "min": "min({x})",
            "max": "max({x})",
        },
    )


def feature_quantiles(df: DataFrame, group: Sequence[str], features: Sequence[str], points: Sequence[float]) -> DataFrame:
    wanted = ", ".join(repr(float(p)) for p in points)
    sketch = {"quantiles": f"percentile_approx({{x}}, array({wanted}), 10000)"}
    return _per_feature(df, group, features, sketch)


def feature_stats_json(stats: DataFrame, version: str) -> DataFrame:
    """The statistics contract of a dataset as one JSON document; one entry per feature."""
    values = ["count", "max", "mean", "min", "nulls", "std"]
    inner = F.struct(*[F.col(v).cast("double").alias(v) for v in values])
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("feature"), inner))))
    document = F.struct(F.lit(version).alias("schema_version"), entries.alias("stats"))
    return stats.agg(F.to_json(document).alias("document"))


def psi(df: DataFrame, split: str, left: str, right: str, features: Sequence[str], bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index between two sides of a table over equal-width bins of the joint range.

    Missing values have a bin of their own. A side without rows counts as empty bins.
    """
    ranges = df.agg(
        F.struct(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in features]).alias("r")
    ).scalar()

    def bin_of(f: str) -> Column:
        lo, hi = F.col("_ranges")[f]["lo"], F.col("_ranges")[f]["hi"]
        width = F.when(hi > lo, (hi - lo) / bins)
        inside = F.coalesce(F.least(F.lit(bins - 1), F.floor((F.col(f) - lo) / width).cast("int")), F.lit(0))
        return F.when(F.col(f).isNull(), F.lit(-1)).otherwise(inside)

    cells = df.withColumn("_ranges", ranges).select(
        F.col(split).alias("side"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(f).alias("bin")) for f in features]))
    )
    counted = cells.groupBy("feature", "bin").agg(
        F.count_if(F.col("side") == left).alias("l"), F.count_if(F.col("side") == right).alias("r")
    )
    totals = counted.groupBy("feature").agg(F.sum("l").alias("tl"), F.sum("r").alias("tr"))
    p = F.greatest(F.coalesce(F.try_divide("l", "tl"), F.lit(0.0)), F.lit(floor))
    q = F.greatest(F.coalesce(F.try_divide("r", "tr"), F.lit(0.0)), F.lit(floor))
    return (
        counted.join(totals, "feature")
        .groupBy("feature")
        .agg(F.round(F.sum((p - q) * F.ln(p / q)), 6).alias("psi"))
    )


def feature_drift(df: DataFrame, split: str, left: str, right: str, features: Sequence[str]) -> DataFrame:
    """Statistics of both sides next to each other, with the stability index."""
    stats = feature_stats(df.filter(F.col(split).isin(left, right)), [split], features)

    def side(name: str) -> DataFrame:
        return stats.filter(F.col(split) == name).select(
            "feature", *[F.col(s).alias(f"{name}_{s}") for s in ("count", "mean", "std", "min", "max")]
        )

    return side(left).join(side(right), "feature", "full").join(psi(df, split, left, right, features), "feature", "full")
