"""Quantiles that add up: mergeable KLL sketch states per day, combined to any longer period without reading old days again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Size of a sketch; about 8 bytes times three of this are stored per state.
SKETCH_K = 1024


def rank_error(k: int = SKETCH_K) -> float:
    """Published normalized rank error of a KLL sketch: 99 of 100 single quantiles are off by no more, however many were merged."""
    return 2.296 / k**0.9021


def _usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def quantile_states(df: DataFrame, value: str, group: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """One state per group: row_count, n (usable values), low, high, sketch. Null and NaN are counted as rows only.

    Sketches are built in each task and merged, so a hot group costs no more than its tasks.
    """
    number = F.col(value).cast("double")
    usable = F.when(_usable(number), number)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(usable).alias("n"),
        F.min(usable).alias("low"),
        F.max(usable).alias("high"),
        F.kll_sketch_agg_double(usable, k).alias("sketch"),
    )


def merge_quantile_states(states: DataFrame, group: Sequence[str]) -> DataFrame:
    """States of parts to the states of coarser groups."""
    return states.groupBy(*group).agg(
        F.sum("row_count").alias("row_count"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def quantiles(states: DataFrame, ranks: Sequence[float]) -> DataFrame:
    """One row per state and rank: q and value in place of the sketch; a state without usable values has null."""
    # The ends are kept exactly beside the sketch, so ranks 0 and 1 need no estimate.
    def estimate(q: float) -> Column:
        if q <= 0 or q >= 1:
            return F.col("low" if q <= 0 else "high")
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))

    points = [F.struct(F.lit(q).alias("q"), estimate(q).alias("value")) for q in map(float, ranks)]
    return states.select(*[c for c in states.columns if c != "sketch"], F.inline(F.array(*points)))


def within_rank_error(estimates: DataFrame, rows: DataFrame, value: str, group: Sequence[str], bound: float) -> DataFrame:
    """Whether each estimate's true rank is within ``bound`` of its q. Reads the rows: a check of sketches, not a way to use them.

    The estimates of a group travel as one small array, and counts per estimate are combined before the shuffle.
    """
    number = F.col(value).cast("double")
    points = estimates.groupBy(*group).agg(F.collect_list(F.struct("q", "value")).alias("_points"))
    usable = rows.where(_usable(number)).select(*group, number.alias("_x"))
    pairs = usable.join(points, list(group)).select(*group, "_x", F.inline("_points"))
    ranks = pairs.groupBy(*group, "q").agg(F.avg((F.col("_x") < F.col("value")).cast("int")).alias("_below"), F.avg((F.col("_x") <= F.col("value")).cast("int")).alias("_upto"))
    checked = estimates.join(ranks, [*group, "q"], "left")
    fits = F.coalesce(F.col("q").between(F.col("_below") - bound, F.col("_upto") + bound), F.col("value").isNull())
    return checked.withColumn("within", fits).drop("_below", "_upto")
