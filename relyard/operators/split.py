"""Exact stratified split without sorting or shuffling the dataset rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relyard import constants as c
from relyard.functions.columns import with_once
from relyard.functions.hashing import sha256_text
from relyard.operators.ordered import exact_rank, lookup_join, running_sums
from relyard.session import shared_root

#: Rows of one hash prefix of one class that one task ranks, about.
ROWS_PER_PREFIX = 1_000_000
BANDS = 1024


def class_key(label: str) -> Column:
    """Never null, so that rows without a label are a class of their own and keep their share too."""
    value = F.col(label).cast("string")
    return F.when(value.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), value))


def test_sizes(counts: DataFrame, label: str, share: float) -> DataFrame:
    """Exact test rows per class: ceil(share * n) in all, split by largest remainder, ties by label.

    Works on one row per class, in whole numbers wide enough for any table. Totals reach the classes as a scalar, and the
    order of the remainders is a rank over bands, so any number of classes will do.
    """
    whole = "decimal(18,0)"
    total = counts.agg(F.sum("n").alias("n")).scalar()
    wanted = F.ceil(F.round(F.lit(share) * F.col("_total"), 9))
    shared = counts.select(label, "n", total.cast(whole).alias("_total")).withColumn("_wanted", wanted)
    shared = shared.withColumn("_product", F.col("n").cast(whole) * F.col("_wanted").cast(whole))
    shared = shared.withColumn("_rest", F.col("_product") % F.col("_total"))
    floored = shared.withColumn("_floor", ((F.col("_product") - F.col("_rest")) / F.col("_total")).cast("bigint"))
    given = floored.agg(F.sum("_floor").alias("n")).scalar()
    banded = floored.withColumn("_band", -F.floor(F.col("_rest").cast("double") / F.col("_total").cast("double") * BANDS))
    placed = exact_rank(banded, [], ["_band"], [F.col("_rest").desc(), F.col(label)], "_place").withColumn("_given", given)
    extra = (F.col("_place") <= F.col("_wanted") - F.col("_given")).cast("int")
    return placed.select(label, "n", (F.col("_floor") + extra).alias("n_test"))


def split_cuts(
    df: DataFrame, label: str, row_id: str, share: float = c.TEST_SHARE, seed: int = c.SPLIT_SEED, prefix_digits: int | None = None
) -> DataFrame:
    """Per class (``class_key``), the hash (and id) of the last test row.

    Rows are ordered by sha256(seed:id). Counts per hash prefix tell in which prefix the cut lies; only
    the rows of that one prefix per class are ranked. The prefix is as long as the number of rows asks for.
    """
    if prefix_digits is None:
        rows, prefix_digits = df.count(), 4
        while rows / 16**prefix_digits > ROWS_PER_PREFIX:
            prefix_digits += 1
    keyed = df.select(
        class_key(label).alias("_label"),
        F.col(row_id).alias("_id"),
        sha256_text(F.concat(F.lit(f"{seed}:"), F.col(row_id))).alias("_hash"),
    ).withColumn("_prefix", F.substring("_hash", 1, prefix_digits))
    prefixes = keyed.groupBy("_label", "_prefix").agg(F.count(F.lit(1)).alias("n"))
    sizes = test_sizes(prefixes.groupBy("_label").agg(F.sum("n").alias("n")), "_label", share)
    coarse = prefixes.withColumn("_head", F.substring("_prefix", 1, 2))
    running = running_sums(coarse, ["_label"], ["_head"], ["_prefix"], {"_before": F.col("n")})
    placed = running.join(sizes.select("_label", "n_test"), "_label")
    holding = placed.filter((F.col("_before") < F.col("n_test")) & (F.col("_before") + F.col("n") >= F.col("n_test")))
    cut_prefix = holding.select("_label", F.col("_prefix").alias("_at"), (F.col("n_test") - F.col("_before")).alias("_need"))
    # One row per class; kept, as measuring and joining would each work it out again.
    shared_root(df.sparkSession)
    inside = lookup_join(keyed, cut_prefix.checkpoint(), ["_label"], ["_id"], how="inner").filter(F.col("_prefix") == F.col("_at"))
    order = Window.partitionBy("_label", "_prefix").orderBy("_hash", "_id")
    return (
        inside.withColumn("_pos", F.row_number().over(order))
        .filter(F.col("_pos") == F.col("_need"))
        .select("_label", F.struct("_hash", "_id").alias("cut"))
    )


def stratified_split(
    df: DataFrame, label: str, row_id: str, share: float = c.TEST_SHARE, seed: int = c.SPLIT_SEED
) -> DataFrame:
    """Add ``split`` ('train' or 'test'). Row ids are unique; class sizes come out exact for any number of classes.

    The final pass compares each row with the cut of its class, so wide rows never move while the cuts are few.
    """
    cuts = split_cuts(df, label, row_id, share, seed).checkpoint()
    here = F.struct(
        sha256_text(F.concat(F.lit(f"{seed}:"), F.col(row_id))).alias("_hash"), F.col(row_id).alias("_id")
    )
    found = lookup_join(df.withColumn("_label", class_key(label)), cuts, ["_label"], [row_id])
    side = F.when(F.col("cut").isNotNull() & (here <= F.col("cut")), F.lit("test")).otherwise(F.lit("train"))
    return with_once(found, split=side).drop("cut", "_label").select(*df.columns, "split")


def write_split(split: DataFrame, path: str) -> None:
    """Train and test folders of one table, so a reader of one side never opens the other."""
    split.write.mode("errorifexists").partitionBy("split").parquet(path)
