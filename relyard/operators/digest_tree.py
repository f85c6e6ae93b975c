"""What changed between two versions of a dataset, and where: digest trees over prefixes of the key's hash.

A leaf holds the additive digest of the rows whose key hashes to its prefix; a node above holds the sum of its leaves. Two versions are
compared from the root down, and only below a node that differs is anything read: a version that changed in a hundred rows costs a
hundred branches, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from relyard.functions.hashing import DIGEST_SUMS, digest_sums, finish_digest, row_text, sha256_text

#: Hex digits of the key hash at each level below the root: 256 branches with 256 leaves each. Stored trees depend on it.
LEVELS = (0, 2, 4)
NODE = "version string, row_count bigint, digest string, level int, branch string, prefix string"


def tree_nodes(df: DataFrame, key: Sequence[str], version: str, levels: Sequence[int] = LEVELS) -> DataFrame:
    """(version, row_count, digest, level, branch, prefix) of every node, from one pass over the rows.

    Rows are summed to leaves in each task; the levels above add up leaves. A row's digest covers all its columns but ``version``.
    """
    columns = [n for n in df.columns if n != version]
    prefix = F.substring(sha256_text(row_text(df, key)), 1, levels[-1]).alias("_prefix")
    leaves = df.groupBy(F.col(version).cast("string").alias("version"), prefix).agg(*digest_sums(sha256_text(row_text(df, columns))))
    places = F.array(*[F.struct(F.lit(i).alias("level"), F.substring("_prefix", 1, n).alias("prefix")) for i, n in enumerate(levels)])
    sums = [F.sum(n).alias(n) for n in ("row_count", *DIGEST_SUMS)]
    nodes = leaves.select("*", F.inline(places)).groupBy("version", "level", "prefix").agg(*sums)
    # The folder of a node is named by its parent, so the children of one branch are read without the others.
    parents = F.when(F.col("level") == 0, F.lit("top"))
    for i, n in enumerate(levels[:-1]):
        parents = parents.when(F.col("level") == i + 1, F.concat(F.lit("p"), F.substring("prefix", 1, n)))
    return nodes.select("version", "row_count", finish_digest().alias("digest"), "level", parents.alias("branch"), "prefix")


def write_tree(nodes: DataFrame, path: str) -> None:
    """One folder per branch, with few files each; new versions are appended."""
    nodes.repartition("level", "branch").write.mode("append").partitionBy("level", "branch").parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(path)


def _pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(previous_version, version, prefix, rows_before, rows_after) of the nodes that differ between the versions of each pair."""
    old = pairs.join(nodes.select(F.col("version").alias("previous_version"), "prefix", F.col("row_count").alias("_n"), F.col("digest").alias("_d")), "previous_version")
    new = pairs.join(nodes.select("version", "prefix", "row_count", "digest"), "version")
    both = old.join(new, ["previous_version", "version", "prefix"], "full")
    return both.where(~F.col("_d").eqNullSafe(F.col("digest"))).select(
        "previous_version", "version", "prefix", F.coalesce("_n", F.lit(0)).alias("rows_before"), F.coalesce("row_count", F.lit(0)).alias("rows_after")
    )


def differing_leaves(tree: DataFrame, pairs: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """The leaves that differ between the versions of each pair (previous_version, version).

    From the root down; the differing nodes of one level name the folders that are read of the next.
    """
    differing = _pairs(tree.where(F.col("level") == 0), pairs)
    for i in range(1, len(levels)):
        branches = differing.select("previous_version", "version", F.concat(F.lit("p"), "prefix").alias("branch")).distinct()
        found = _pairs(branch_nodes(tree, i, branches), pairs).withColumn("branch", F.concat(F.lit("p"), F.substring("prefix", 1, levels[i - 1])))
        differing = found.join(branches, ["previous_version", "version", "branch"], "left_semi").drop("branch")
    return differing


def branch_nodes(tree: DataFrame, level: int, branches: DataFrame) -> DataFrame:
    """The nodes of a level below the given branches. Names of branches are few (16 to the digits of the level above), so they are sent
    to the scan as values and other folders are not opened."""
    names = [r.branch for r in branches.select("branch").distinct().collect()]
    return tree.where((F.col("level") == level) & F.col("branch").isin(names))


FLAGS = {"schema": "schema_hash", "content": "content_hash", "rows": "row_count", "config": "config_hash"}


def version_drift(versions: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Each version with the one before it and four flags: did schema, content, number of rows or config change; null counts as a value.

    ``versions`` has one row per version of a dataset with ``FLAGS``' columns; a dataset's versions are few, so one window orders them.
    """
    by = Window.partitionBy(*group).orderBy(order)
    changed = {f"{name}_changed": ~F.col(column).eqNullSafe(F.lag(column).over(by)) for name, column in FLAGS.items()}
    before: Column = F.lag(order).over(by).alias(f"previous_{order}")
    flagged = versions.select(*group, before, order, *[flag.alias(name) for name, flag in changed.items()])
    names = F.concat_ws(",", *[F.when(F.col(f"{name}_changed"), F.lit(name)) for name in FLAGS])
    return flagged.where(F.col(f"previous_{order}").isNotNull()).withColumn("changed", names)
