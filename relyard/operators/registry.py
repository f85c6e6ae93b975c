"""Registry tables: experiments, runs, registration, references, alias history, readiness, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relyard import constants as c
from relyard.functions.text import gate_is_true, parse_model_uri, strip_or_empty, strip_or_null
from relyard.operators.ordered import exact_rank, latest_before, needed_bins, previous_values, lookup_join
from relyard.operators.policy import alias_versions


def day_of(ts: str) -> Column:
    """Days since 1970-01-01: the usual bin of time-ordered operators."""
    return F.datediff(F.col(ts), F.lit("1970-01-01"))


def ensure_experiments(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Existing names plus the wanted ones that are not there yet."""
    new = wanted.select("experiment").distinct().join(existing, "experiment", "left_anti")
    return existing.select("experiment", F.lit(False).alias("created")).unionByName(
        new.select("experiment", F.lit(True).alias("created"))
    )


def latest_train_run(runs: DataFrame) -> DataFrame:
    """Newest train run per experiment; ties go to the larger run id; null where none exists."""
    is_train = F.col("step") == "train"
    return runs.groupBy("experiment").agg(
        F.max_by("run_id", F.when(is_train, F.struct("start_time", "run_id"))).alias("run_id")
    )


def copied_tags(tags: Column) -> Column:
    """The tag keys a version inherits from its run: trimmed, blanks left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), strip_or_null(F.try_element_at(tags, F.lit(k))).alias("value")) for k in c.COPIED_TAGS])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def register_versions(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """New versions for the train runs whose gate says true; failed gates leave no version, and neither does a run that has one.

    Numbers go on after the newest version of the model, in order of run start. Running it again adds nothing.
    """
    source = strip_or_null(F.try_element_at(F.col("tags"), F.lit("source_run_id")))
    registered = versions.select(source.alias("run_id")).filter("run_id IS NOT NULL")
    passed = runs.join(registered, "run_id", "left_anti").filter((F.col("step") == "train") & gate_is_true(F.col("gate_ok"))).select(
        "model_name", "run_id", "start_time", "tags", day_of("start_time").alias("_day")
    )
    bins = needed_bins(passed, ["model_name"], ["_day", "start_time"])
    ranked = exact_rank(passed, ["model_name"], bins, ["start_time", "run_id"], "_n")
    newest = versions.groupBy("model_name").agg(F.max("version").alias("_newest"))
    fixed = F.create_map(
        F.lit("source_run_id"), F.col("run_id"),
        F.lit("gate"), F.lit(c.GATE_PASSED),
        F.lit("release_status"), F.lit(c.CANDIDATE),
    )
    return lookup_join(ranked, newest, ["model_name"], ["run_id"]).select(
        "model_name",
        (F.coalesce("_newest", F.lit(0)) + F.col("_n")).alias("version"),
        F.col("run_id").alias("source_run_id"),
        F.map_concat(fixed, copied_tags(F.col("tags"))).alias("tags"),
        F.col("start_time").alias("created_at"),
    )


def candidate_changes(new_versions: DataFrame) -> DataFrame:
    """Registration moves the candidate alias to the newest version."""
    return new_versions.groupBy("model_name").agg(F.max("version").alias("version")).select(
        "model_name", F.lit(c.CANDIDATE).alias("alias"), "version"
    )


def resolve_refs(refs: DataFrame, aliases: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Resolve model URIs (column ``uri``) to version and run; what cannot be resolved stays null.

    Each distinct URI is resolved once; a popular one then comes back through a lookup join.
    """
    distinct = refs.select("uri").distinct().select("uri", parse_model_uri(F.col("uri")).alias("ref")).select("uri", "ref.*")
    own_key = F.concat(F.lit("\x00"), F.col("uri"))
    pointed = aliases.select("model_name", "alias", F.col("version").alias("alias_version"))
    by_alias = (
        distinct.withColumn("model_name", F.coalesce("model_name", own_key))
        .join(pointed, ["model_name", "alias"], "left")
        .withColumn("version", F.coalesce("version", "alias_version"))
    )
    registered = versions.select("model_name", "version", "source_run_id", F.lit(True).alias("_known"))
    with_run = by_alias.join(registered, ["model_name", "version"], "left").withColumn(
        "run_id", F.coalesce("run_id", strip_or_null(F.col("source_run_id")))
    )
    known_runs = runs.select(F.col("run_id").alias("_run_key"), F.lit(True).alias("run_found"))
    resolved = (
        with_run.withColumn("_run_key", F.coalesce("run_id", own_key))
        .join(known_runs, "_run_key", "left")
        .select(
            "uri",
            F.when(~F.startswith(F.col("model_name"), F.lit("\x00")), F.col("model_name")).alias("model_name"),
            F.when(F.col("_known"), F.col("version")).alias("version"),
            "run_id",
            F.coalesce("run_found", F.lit(False)).alias("run_found"),
        )
    )
    spread = [name for name in refs.columns if name != "uri"] or ["uri"]
    return lookup_join(refs, resolved, ["uri"], spread)


def alias_intervals(events: DataFrame) -> DataFrame:
    """Alias events (model_name, alias, version, ts, seq) -> validity intervals; the last is open."""
    # Walking the events backwards turns "next event" into "previous row".
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    binned = events.withColumns({"_bin": -day_of("ts"), "_back": -since, "_back_seq": -F.col("seq")})
    bins = needed_bins(binned, ["model_name", "alias"], ["_bin", "_back"])
    following = previous_values(
        binned, ["model_name", "alias"], bins, ["_back", "_back_seq"], {"valid_to": "ts"}
    )
    return following.select("model_name", "alias", "version", F.col("ts").alias("valid_from"), "valid_to")


def alias_as_of(events: DataFrame, probes: DataFrame) -> DataFrame:
    """Version behind (model_name, alias) at each probe time; an event at the same instant counts.

    Events and probes are sorted together and the last version is carried forward, so no pair of
    probe and interval is ever formed and hot models are split by day.
    """
    extra = [name for name in probes.columns if name not in ("model_name", "alias", "ts")]
    changes = events.select(
        "model_name", "alias", "ts", F.lit(0).alias("_kind"), F.col("seq").alias("_seq"), "version",
        *[F.lit(None).cast(dict(probes.dtypes)[name]).alias(name) for name in extra],
    )
    asked = probes.select(
        "model_name", "alias", "ts", F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_seq"),
        F.lit(None).cast("bigint").alias("version"), *extra,
    )
    merged = changes.unionByName(asked).withColumns({"_bin": day_of("ts"), "_minute": F.date_trunc("minute", "ts")})
    bins = needed_bins(merged, ["model_name", "alias"], ["_bin", "_minute"])
    carried = latest_before(
        merged, ["model_name", "alias"], bins, ["ts", "_kind", "_seq"], "version", "as_of_version"
    )
    return carried.filter(F.col("_kind") == 1).select("model_name", "alias", "ts", *extra, "as_of_version")


def not_ready(models: DataFrame, aliases: DataFrame, versions: DataFrame, loadable: DataFrame) -> DataFrame:
    """Models that cannot serve: no prod alias, no such version, or nothing to load for it."""
    prod = alias_versions(aliases, {"version": c.PROD})
    known = versions.select("model_name", "version", "source_run_id", F.lit(True).alias("_known"))
    own_key = F.concat(F.lit("\x00"), F.col("model_name"))
    runs = loadable.select(F.col("run_id").alias("_run_key"), F.lit(True).alias("_loadable"))
    reason = (
        F.when(F.col("version").isNull(), F.lit("prod alias missing"))
        .when(F.col("_known").isNull(), F.lit("version missing"))
        .when(F.col("_loadable").isNull(), F.lit("run missing"))
    )
    return (
        models.select("model_name")
        .join(prod, "model_name", "left")
        .join(known, ["model_name", "version"], "left")
        .withColumn("_run_key", F.coalesce(strip_or_null(F.col("source_run_id")), own_key))
        .join(runs, "_run_key", "left")
        .select("model_name", F.col("version").alias("prod_version"), reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def lineage(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Version -> source run -> fingerprint and config, with orphans marked.

    Both sides grow with the registry, so neither is repeated or broadcast; a run that very many versions
    point at is left to the adaptive skew join.
    """
    own_key = F.concat_ws("/", F.lit("\x00"), "model_name", F.col("version").cast("string"))
    described = runs.select(
        F.col("run_id").alias("_run_key"),
        "experiment",
        strip_or_null(F.try_element_at("tags", F.lit("dataset_fingerprint"))).alias("run_fingerprint"),
        strip_or_null(F.try_element_at("tags", F.lit("git_sha"))).alias("run_git_sha"),
        F.lit(True).alias("_found"),
    )
    return (
        versions.withColumn("_run_key", F.coalesce(strip_or_null(F.col("source_run_id")), own_key))
        .join(described, "_run_key", "left")
        .select(
            "model_name",
            "version",
            strip_or_null(F.col("source_run_id")).alias("source_run_id"),
            "experiment",
            "run_fingerprint",
            "run_git_sha",
            F.col("_found").isNull().alias("orphan"),
        )
    )


def fingerprint_diff(versions: DataFrame) -> DataFrame:
    """Which lineage tags changed from one version of a model to the next one that exists."""
    watched = ("dataset_fingerprint", "git_sha", "config_hash")
    flat = versions.select(
        "model_name",
        "version",
        F.shiftright("version", 20).alias("_million"),
        F.shiftright("version", 10).alias("_thousand"),
        *[strip_or_empty(F.try_element_at("tags", F.lit(k))).alias(k) for k in watched],
    )
    bins = needed_bins(flat, ["model_name"], ["_million", "_thousand"])
    before = previous_values(
        flat, ["model_name"], bins, ["version"],
        {"previous_version": "version", **{f"_old_{k}": k for k in watched}},
    )
    changed = [F.when(F.col(k) != F.col(f"_old_{k}"), F.lit(k)) for k in watched]
    return before.filter(F.col("previous_version").isNotNull()).select(
        "model_name", "previous_version", "version", F.concat_ws(",", *changed).alias("changed")
    )
