"""Binary classification metrics as grouped aggregations, exact AUC and ROC points, quality gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from relyard import constants as c
from relyard.functions.columns import with_once
from relyard.functions.scoring import label_of
from relyard.operators.ordered import lookup_join, previous_values, running_sums, score_band


def confusion(scored: DataFrame, group: Sequence[str], threshold: float = c.DECISION_THRESHOLD) -> DataFrame:
    """The four cells of each group, and ``invalid``: rows without a label or a usable score, which belong to none."""
    predicted, actual, ok = label_of(F.col("score"), threshold) == 1, F.col("label") == 1, usable()
    return scored.groupBy(*group).agg(
        F.count_if(ok & predicted & actual).alias("tp"),
        F.count_if(ok & predicted & ~actual).alias("fp"),
        F.count_if(ok & ~predicted & ~actual).alias("tn"),
        F.count_if(ok & ~predicted & actual).alias("fn"),
        F.count_if(~ok).alias("invalid"),
    )


def usable() -> Column:
    """Never null: the row has a label and a score that is a number."""
    return F.col("label").isNotNull() & F.col("score").isNotNull() & ~F.coalesce(F.isnan("score"), F.lit(True))


def accuracy_of() -> Column:
    """Null for a group with invalid rows, or with no rows at all."""
    share = F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return F.when(F.col("invalid") == 0, share)


def f1_of() -> Column:
    """Zero where nothing is or should be positive; null for a group with invalid rows."""
    weight = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(F.col("invalid") == 0, F.coalesce(F.try_divide(2 * F.col("tp"), weight), F.lit(0.0)))


# Coarse and fine score bands; the fine ones split a coarse band that holds very many distinct scores.
BANDS = {"_band": 64, "_fine": 64 * 1024}


def collapse(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per distinct score with ``counts`` (pos, neg, invalid), so ties and copies never reach a sort.

    The counts travel as one value: every later use then needs the very same shuffle, and Spark
    computes it once.
    """
    counted = scored.groupBy(*group, "score").agg(
        F.count_if(usable() & (F.col("label") == 1)).alias("pos"),
        F.count_if(usable() & (F.col("label") != 1)).alias("neg"),
        F.count_if(~usable()).alias("invalid"),
    )
    return with_once(counted, counts=F.struct("pos", "neg", "invalid")).select(*group, "score", "counts")


def _banded(collapsed: DataFrame, sign: int) -> DataFrame:
    # Never null, so that no null filter creeps below one use of the collapsed rows and not the other.
    bands = {name: F.coalesce(sign * score_band(F.col("score"), steps), F.lit(0)) for name, steps in BANDS.items()}
    return collapsed.withColumns(bands)


def _as_scored(scored: DataFrame, score_kind: str) -> DataFrame:
    """``score_kind='label'`` replaces the probability by its thresholded 0/1 prediction."""
    if score_kind == "label":
        hard = F.when(~F.isnan("score"), label_of(F.col("score"), c.DECISION_THRESHOLD).cast("double"))
        return scored.withColumn("score", hard)
    return scored


def roc_auc(scored: DataFrame, group: Sequence[str], score_kind: str = "probability") -> DataFrame:
    """Exact AUC per group, ties counting half; null when only one class is present or a row is invalid."""
    return _auc_of(collapse(_as_scored(scored, score_kind), group), group)


def _auc_of(collapsed: DataFrame, group: Sequence[str], more: dict[str, Column] | None = None) -> DataFrame:
    """AUC per group from collapsed rows, with further aggregates of the same rows."""
    others = more or {}
    pos, neg = F.col("counts.pos"), F.col("counts.neg")
    points = running_sums(_banded(collapsed, 1), group, list(BANDS), ["score"], {"neg_below": neg})
    # Twice the rank statistic stays a whole number; decimal keeps it exact for any table size.
    wins = pos.cast("decimal(18,0)") * (2 * F.col("neg_below") + neg).cast("decimal(18,0)")
    summed = points.groupBy(*group).agg(
        F.sum(pos).alias("positives"), F.sum(neg).alias("negatives"), F.sum("counts.invalid").alias("invalid"),
        F.sum(wins).cast("double").alias("_wins"),
        *[value.alias(name) for name, value in others.items()],
    )
    pairs = 2.0 * F.col("positives") * F.col("negatives")
    auc = F.when(F.col("invalid") == 0, F.try_divide(F.col("_wins"), F.nullif(pairs, F.lit(0.0))))
    return summed.select(*group, "positives", "negatives", "invalid", auc.alias("auc"), *others)


def roc_points(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """(fpr, tpr, threshold) for every distinct score, from (0, 0) at an infinite threshold down.

    A curve is drawn over usable rows; :func:`confusion` counts the others.
    """
    return _points_of(collapse(scored.filter(usable()), group), group)


def roc_corners(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """The points of :func:`roc_points` at which the curve turns, and both its ends: the same curve, with no three points on a line.

    A score's own counts are the step to its point and those of the next lower score the step away from it, so one look at the neighbour
    decides, before anything is summed up.
    """
    collapsed = collapse(scored.filter(usable()), group).withColumns({"_pos": F.col("counts.pos"), "_neg": F.col("counts.neg")})
    onward = previous_values(_banded(collapsed, 1), group, list(BANDS), ["score"], {"_next_pos": "_pos", "_next_neg": "_neg"})
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    turns = F.col("_next_pos").isNull() | (wide("_pos") * wide("_next_neg") != wide("_next_pos") * wide("_neg"))
    return _points_of(onward.withColumn("_turns", turns).drop(*BANDS), group, F.col("_turns"))


def _points_of(collapsed: DataFrame, group: Sequence[str], kept: Column | None = None) -> DataFrame:
    pos, neg = F.col("counts.pos"), F.col("counts.neg")
    points = running_sums(
        _banded(collapsed, -1), group, list(BANDS), [F.col("score").desc()], {"tp_above": pos, "fp_above": neg}
    )
    totals = collapsed.groupBy(*group).agg(F.sum(pos).alias("positives"), F.sum(neg).alias("negatives"))
    zero = F.lit(0).cast("bigint")
    points = points if kept is None else points.where(kept)
    start = totals.select(*group, F.lit(float("inf")).alias("threshold"), zero.alias("tp"), zero.alias("fp"))
    counted = points.select(
        *group,
        F.col("score").alias("threshold"),
        (F.col("tp_above") + pos).alias("tp"),
        (F.col("fp_above") + neg).alias("fp"),
    ).unionByName(start)

    def rate(n: str, d: str) -> Column:
        return F.when(F.col(d) > 0, F.round(F.col(n) / F.when(F.col(d) > 0, F.col(d)), 6))

    return lookup_join(counted, totals, group, ["threshold"], how="inner").select(
        *group, "threshold", rate("fp", "negatives").alias("fpr"), rate("tp", "positives").alias("tpr")
    )


def gate_passes(auc: Column, minimum: float = c.GATE_MIN_AUC) -> Column:
    """False for null and NaN: Spark itself orders NaN above every number."""
    return F.coalesce(~F.isnan(auc) & (auc >= F.lit(minimum)), F.lit(False))


def gate_text(auc: Column, minimum: float = c.GATE_MIN_AUC) -> Column:
    return F.when(gate_passes(auc, minimum), F.lit("true")).otherwise(F.lit("false"))


def report(
    scored: DataFrame, group: Sequence[str], prefix: str = "eval_", score_kind: str = "probability"
) -> DataFrame:
    """One row per model: accuracy, F1, AUC and the gate. With an invalid row the metrics are null and the gate is false."""
    collapsed = collapse(_as_scored(scored, score_kind), group)
    pos, neg = F.col("counts.pos"), F.col("counts.neg")
    hit = label_of(F.col("score"), c.DECISION_THRESHOLD) == 1
    part = lambda n, at: F.coalesce(F.sum(F.when(at, n)), F.lit(0))
    cells = {"tp": part(pos, hit), "fp": part(neg, hit), "tn": part(neg, ~hit), "fn": part(pos, ~hit)}
    return _auc_of(collapsed, group, cells).select(
        *group,
        F.round(accuracy_of(), 6).alias(f"{prefix}accuracy"),
        F.round(f1_of(), 6).alias(f"{prefix}f1"),
        F.round("auc", 6).alias(f"{prefix}roc_auc"),
        gate_text(F.col("auc")).alias("gate_ok"),
    )


def metrics_long(reports: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return reports.unpivot(list(keys), list(metrics), "metric", "value")


def metrics_pivot(long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long metric rows back to one column per metric; the metric names are given, so no extra scan."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.max("value"))


def score_range(scored: DataFrame, rows: str, proba: str) -> DataFrame:
    """One probability per row, each inside [0, 1] and not NaN."""
    inside = F.forall(proba, lambda p: p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0))
    return scored.withColumn("in_range", inside).withColumn("one_per_row", F.size(proba) == F.size(rows))
