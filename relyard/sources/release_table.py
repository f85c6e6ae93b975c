"""Release state as one table: aliases and version tags change together because they are rows of one write.

Every state has a path of its own and is never written again; who made it hands the path on. Of two writers that start from one state,
each leaves its own next state whole, and neither can touch the other's or the one they started from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relyard.session import new_location

PART = "part"


def store(aliases: DataFrame, versions: DataFrame, path: str | None = None) -> str:
    """Write a state to a fresh path and return it. A path that holds anything is refused; a failed write leaves no readable state."""
    path = path or new_location(aliases.sparkSession, "release-state")
    no_alias, no_tags = F.lit(None).cast("string").alias("alias"), F.lit(None).cast("map<string,string>").alias("tags")
    pointers = aliases.select(F.lit("aliases").alias(PART), "model_name", "alias", F.col("version").cast("bigint").alias("version"), no_tags)
    tagged = versions.select(F.lit("versions").alias(PART), "model_name", no_alias, F.col("version").cast("bigint").alias("version"), "tags")
    pointers.unionByName(tagged).write.mode("errorifexists").partitionBy(PART).parquet(path)
    return path


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Aliases and versions of a stored state; each reads its own part only."""
    schema = "part string, model_name string, alias string, version bigint, tags map<string,string>"
    rows = spark.read.schema(schema).parquet(path)
    aliases = rows.where(F.col(PART) == "aliases").select("model_name", "alias", "version")
    return aliases, rows.where(F.col(PART) == "versions").select("model_name", "version", "tags")
