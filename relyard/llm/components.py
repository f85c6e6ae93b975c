"""Connected components of a link table, with tables all the way (alternating large star and small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relyard.llm.common import stored


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def star_components(links: DataFrame) -> DataFrame:
    """(u, v) links to (node, root): root is the smallest node that can be reached. Nodes without a link don't appear.

    Every round maps links to links, at most two per link and never all pairs of a group; it ends when the links no
    longer change. Each round is written to the shared folder, so a lost executor repeats at most one round.
    Minima are combined before the shuffle; the joins leave a hot node to adaptive skew handling.
    """
    two = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = stored(two, "links")
    state = _digest(current)
    while state[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("low"))
        large = both.join(lowest, both["u"] == lowest["w"]).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), "low")
        joined = large.join(lows, large["u"] == lows["w"])
        small = joined.select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        current = stored(small.distinct(), "links")
        before, state = state, _digest(current)
        if state == before:
            break
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
