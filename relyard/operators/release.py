"""Promotion, rollback and undo as new snapshots of the alias and version tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relyard import constants as c
from relyard.functions.text import strip_or_null, tag
from relyard.operators.policy import alias_versions


def upsert_aliases(aliases: DataFrame, changes: DataFrame) -> DataFrame:
    """(model_name, alias) -> version with changes taking over; changes are unique per key."""
    new = changes.select("model_name", "alias", F.col("version").alias("new_version"))
    return aliases.join(new, ["model_name", "alias"], "full").select(
        "model_name", "alias", F.coalesce("new_version", "version").alias("version")
    )


def merge_tags(old: Column, new: Column) -> Column:
    """Union of two tag maps in which the new value wins."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def upsert_tags(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (model_name, version, updates map) rows; changes are unique per version."""
    new = changes.select("model_name", "version", "updates")
    merged = F.when(F.col("updates").isNotNull(), merge_tags(F.col("tags"), F.col("updates")))
    joined = versions.join(new, ["model_name", "version"], "left")
    return joined.withColumn("tags", F.coalesce(merged, F.col("tags"))).select(*versions.columns)


def promotion_changes(decisions: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alias and tag changes of every allowed decision.

    Whatever alias was decided about, prod and champion move, and the version that is prod now becomes the previous one.
    """
    prod = alias_versions(aliases, {"previous": c.PROD})
    allowed = (
        decisions.filter("allowed")
        .select("model_name", "from_alias", F.col("candidate_version").cast("bigint").alias("version"))
        .join(prod, "model_name", "left")
    )
    alias_changes = allowed.select(
        "model_name", F.explode(F.array(F.lit(c.PROD), F.lit(c.CHAMPION))).alias("alias"), "version"
    )
    # A version that is prod already is marked as its own predecessor, the last of the marks it would get one by one.
    again = F.col("version") == F.col("previous")
    status = F.when(again, F.lit(c.PREVIOUS_PROD)).otherwise(F.lit(c.PROD))
    evidence = F.create_map(F.lit("release_status"), status, F.lit("promoted_from_alias"), F.col("from_alias"))
    pointer = F.create_map(F.lit("previous_prod_version"), F.col("previous").cast("string"))
    no_pointer = F.create_map().cast("map<string,string>")
    promoted = F.map_concat(evidence, F.when(F.col("previous").isNotNull(), pointer).otherwise(no_pointer))
    retired = F.create_map(F.lit("release_status"), F.lit(c.PREVIOUS_PROD))
    entry = F.array(
        F.struct(F.col("version").alias("version"), promoted.alias("updates")),
        F.struct(F.when(~again, F.col("previous")).alias("version"), retired.alias("updates")),
    )
    tag_changes = allowed.select("model_name", F.inline(entry)).filter(F.col("version").isNotNull())
    return alias_changes, tag_changes


def apply_promotion(decisions: DataFrame, aliases: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    alias_changes, tag_changes = promotion_changes(decisions, aliases)
    return upsert_aliases(aliases, alias_changes), upsert_tags(versions, tag_changes)


def rollback_plan(models: DataFrame, aliases: DataFrame, versions: DataFrame) -> DataFrame:
    """model_name, current_version, previous_version, reason (null when the rollback may go on)."""
    prod = alias_versions(aliases, {"current_version": c.PROD})
    tagged = versions.select("model_name", F.col("version").alias("current_version"), "tags")
    previous = strip_or_null(tag(F.col("tags"), "previous_prod_version"))
    known = versions.select("model_name", F.col("version").alias("previous_version"), F.lit(True).alias("_known"))
    reason = (
        F.when(F.col("current_version").isNull(), F.lit("MISSING_PROD_ALIAS"))
        .when(F.col("_pointer").isNull(), F.lit("MISSING_PREVIOUS_PROD_VERSION"))
        .when(F.col("_known").isNull(), F.lit("VERSION_NOT_FOUND"))
    )
    return (
        models.select("model_name")
        .join(prod, "model_name", "left")
        .join(tagged, ["model_name", "current_version"], "left")
        .withColumn("_pointer", previous)
        .withColumn("previous_version", previous.try_cast("bigint"))
        .join(known, ["model_name", "previous_version"], "left")
        .select("model_name", "current_version", "previous_version", reason.alias("reason"))
    )


def rollback(models: DataFrame, aliases: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New aliases, new versions, and the models that cannot roll back.

    Only the prod alias moves; the restored version then points back, which allows one undo.
    """
    plan = rollback_plan(models, aliases, versions)
    ready = plan.filter(F.col("reason").isNull())
    alias_changes = ready.select("model_name", F.lit(c.PROD).alias("alias"), F.col("previous_version").alias("version"))
    pointer = F.create_map(F.lit("previous_prod_version"), F.col("current_version").cast("string"))
    tag_changes = ready.select("model_name", F.col("previous_version").alias("version"), pointer.alias("updates"))
    return (
        upsert_aliases(aliases, alias_changes),
        upsert_tags(versions, tag_changes),
        plan.filter(F.col("reason").isNotNull()),
    )


def alias_consistency(aliases: DataFrame, versions: DataFrame) -> DataFrame:
    """Models whose champion is not prod, or whose prod version does not carry release_status=prod."""
    pointers = alias_versions(aliases, {"prod_version": c.PROD, "champion_version": c.CHAMPION})
    tagged = versions.select(
        "model_name", F.col("version").alias("prod_version"), tag(F.col("tags"), "release_status").alias("prod_status")
    )
    audited = pointers.join(tagged, ["model_name", "prod_version"], "left").select(
        "model_name",
        "prod_version",
        "champion_version",
        (~F.col("prod_version").eqNullSafe(F.col("champion_version"))).alias("champion_differs"),
        (F.col("prod_version").isNotNull() & (F.coalesce("prod_status", F.lit("")) != c.PROD)).alias("status_differs"),
    )
    return audited.filter(F.col("champion_differs") | F.col("status_differs"))
