"""Promotion policy for all models in one pass: three lookups, then array expressions per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relyard import constants as c
from relyard.functions.hashing import canonical_json
from relyard.functions.text import blank, strip_or_empty, strip_or_null, tag

DETAIL_FIELDS = {
    "actual": "string",
    "alias": "string",
    "candidate_version": "string",
    "current_prod_version": "string",
    "expected": "string",
    "missing": "array<string>",
    "run_id": "string",
    "tag": "string",
}


def violation(code: str, message: str, **details: Column) -> Column:
    fields = [
        details.get(name, F.lit(None)).cast(data_type).alias(name) for name, data_type in DETAIL_FIELDS.items()
    ]
    return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.struct(*fields).alias("details"))


def missing_required_tags(tags: Column) -> Column:
    """Required keys that are absent, null or blank, in declared order."""
    return F.array_compact(F.array(*[F.when(blank(tag(tags, k)), F.lit(k)) for k in c.REQUIRED_TAGS]))


def tags_subset(tags: Column) -> Column:
    return F.struct(*[tag(tags, k).alias(k) for k in c.CONTEXT_TAGS])


def alias_versions(aliases: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """One row per model with the version behind each wanted alias (output name -> alias)."""
    picks = [F.max(F.when(F.col("alias") == alias, F.col("version"))).alias(name) for name, alias in wanted.items()]
    return (
        aliases.filter(F.col("alias").isin(*sorted(set(wanted.values()))))
        .groupBy("model_name")
        .agg(*picks)
    )


def evaluate(
    models: DataFrame,
    aliases: DataFrame,
    versions: DataFrame,
    runs: DataFrame,
    from_alias: str = c.CANDIDATE,
    to_alias: str = c.PROD,
) -> DataFrame:
    """Decide for every model whether ``from_alias`` may become ``to_alias``; writes nothing.

    Keys are one row per model, per (model, version) and per run, so no join can blow up. Models
    without a usable run id get a key of their own: they match nothing and do not pile up on one task.
    """
    pointers = alias_versions(aliases, {"candidate_version": from_alias, "current_prod_version": to_alias})
    tagged = versions.select(
        "model_name", F.col("version").alias("candidate_version"), "tags", F.lit(True).alias("version_found")
    )
    known_runs = runs.select(F.col("run_id").alias("run_key"), F.lit(True).alias("run_found"))
    run_id = strip_or_null(tag(F.col("tags"), "source_run_id"))
    joined = (
        models.select("model_name")
        .join(pointers, "model_name", "left")
        .join(tagged, ["model_name", "candidate_version"], "left")
        .withColumn("run_id", run_id)
        .withColumn("run_key", F.coalesce("run_id", F.concat(F.lit("\x00"), F.col("model_name"))))
        .join(known_runs, "run_key", "left")
    )
    return _decide(joined, from_alias, to_alias)


def _decide(joined: DataFrame, from_alias: str, to_alias: str) -> DataFrame:
    tags = F.col("tags")
    candidate, current = F.col("candidate_version"), F.col("current_prod_version")
    gate = strip_or_empty(tag(tags, "gate"))
    status = strip_or_empty(tag(tags, "release_status"))
    missing = missing_required_tags(tags)

    rules = [
        F.when(
            F.size(missing) > 0,
            violation("MISSING_REQUIRED_TAGS", c.MISSING_TAGS_MESSAGE, missing=missing),
        ),
        F.when(
            gate != c.GATE_PASSED,
            violation("GATE_NOT_PASSED", c.GATE_MESSAGE, expected=F.lit(c.GATE_PASSED), actual=gate),
        ),
        F.when(
            status != from_alias,
            violation("INVALID_RELEASE_STATUS", c.STATUS_MESSAGE, expected=F.lit(from_alias), actual=status),
        ),
        F.when(
            candidate == current,
            violation("NOOP_PROMOTION", c.NOOP_MESSAGE, candidate_version=candidate, current_prod_version=current),
        ),
    ]
    no_alias = violation("MISSING_ALIAS", c.MISSING_ALIAS_MESSAGE.format(alias=from_alias), alias=F.lit(from_alias))
    no_version = violation("VERSION_NOT_FOUND", c.VERSION_NOT_FOUND_MESSAGE, candidate_version=candidate)
    no_source = violation("MISSING_SOURCE_RUN_ID", c.NO_SOURCE_RUN_MESSAGE, tag=F.lit("source_run_id"))
    no_run = violation("SOURCE_RUN_ID_NOT_FOUND", c.SOURCE_RUN_NOT_FOUND_MESSAGE, run_id=F.col("run_id"))

    found = F.col("version_found").isNotNull()
    errors = (
        F.when(candidate.isNull(), F.array(no_alias))
        .when(~found, F.array(no_version))
        .otherwise(F.array_compact(F.array(*rules)))
    )
    warnings = F.array_compact(
        F.array(
            F.when(found & F.col("run_id").isNull(), no_source),
            F.when(found & F.col("run_id").isNotNull() & F.col("run_found").isNull(), no_run),
        )
    )
    decided = joined.withColumn("errors", errors).withColumn("warnings", warnings)
    return decided.select(
        "model_name",
        F.lit(from_alias).alias("from_alias"),
        F.lit(to_alias).alias("to_alias"),
        candidate.cast("string").alias("candidate_version"),
        current.cast("string").alias("current_prod_version"),
        F.when(found, tags_subset(tags)).alias("candidate_tags_subset"),
        "errors",
        "warnings",
        (F.size("errors") == 0).alias("allowed"),
    )


def codes(column: str) -> Column:
    return F.concat_ws(",", F.transform(F.col(column), lambda v: v["code"]))


def violations(decisions: DataFrame, kind: str = "errors") -> DataFrame:
    """One row per violation."""
    return decisions.select("model_name", "candidate_version", F.explode(kind).alias("v")).select(
        "model_name", "candidate_version", "v.*"
    )


def as_json(decisions: DataFrame, indent: int | None = None) -> DataFrame:
    """Decision as JSON with sorted keys, compact or indented; context keeps its nulls, details only what they hold."""
    base = ["candidate_version", "current_prod_version", "from_alias", "model_name", "to_alias"]
    subset = F.struct(*[F.col(f"candidate_tags_subset.{k}").alias(k) for k in sorted(c.CONTEXT_TAGS)])
    sorted_subset = F.when(F.col("candidate_tags_subset").isNotNull(), subset)
    keep_nulls = {"ignoreNullFields": "false"}
    context = F.when(
        F.col("candidate_tags_subset").isNull(), F.to_json(F.struct(*base), keep_nulls)
    ).otherwise(F.to_json(F.struct(sorted_subset.alias("candidate_tags_subset"), *base), keep_nulls))

    def listed(column: str) -> Column:
        return F.to_json(
            F.transform(
                F.col(column),
                lambda v: F.struct(v["code"].alias("code"), v["details"].alias("details"), v["message"].alias("message")),
            )
        )

    text = F.concat(
        F.lit('{"allowed":'), F.col("allowed").cast("string"),
        F.lit(',"context":'), context,
        F.lit(',"errors":'), listed("errors"),
        F.lit(',"warnings":'), listed("warnings"), F.lit("}"),
    )
    shown = text if indent is None else canonical_json(text, indent=indent)
    return decisions.select("model_name", shown.alias("decision"))


def as_text(decisions: DataFrame) -> DataFrame:
    """Decision as numbered text lines: allowed, errors, warnings, context."""

    def quoted(value: Column) -> Column:
        escaped = value
        for plain, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(plain), F.lit(shown))
        single, double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
        in_single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        shown = F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(in_single)
        return F.when(value.isNull(), F.lit("None")).otherwise(shown)

    def literal(detail: Column) -> Column:
        pairs = []
        for name, data_type in DETAIL_FIELDS.items():
            value = detail[name]
            shown = quoted(value)
            if data_type.startswith("array"):
                inner = F.concat_ws(", ", F.transform(value, quoted))
                shown = F.concat(F.lit("["), inner, F.lit("]"))
            pairs.append(F.when(value.isNotNull(), F.concat(F.lit(f"'{name}': "), shown)))
        # Two-key details are shown in the order the rule states them.
        first = pairs.pop(list(DETAIL_FIELDS).index("expected"))
        return F.concat(F.lit("{"), F.concat_ws(", ", first, *pairs), F.lit("}"))

    def lines(column: str, label: str) -> Column:
        return F.transform(
            F.col(column),
            lambda v: F.concat(F.lit(label), v["code"], F.lit(": "), v["message"], F.lit(" "), literal(v["details"])),
        )

    subset = F.col("candidate_tags_subset")
    shown_subset = F.concat(
        F.lit(", 'candidate_tags_subset': {"),
        F.concat_ws(", ", *[F.concat(F.lit(f"'{k}': "), quoted(subset[k])) for k in c.CONTEXT_TAGS]),
        F.lit("}"),
    )
    keys = ["model_name", "from_alias", "to_alias", "candidate_version", "current_prod_version"]
    context = F.concat(
        F.lit("context={"),
        F.concat_ws(", ", *[F.concat(F.lit(f"'{k}': "), quoted(F.col(k))) for k in keys]),
        F.when(subset.isNotNull(), shown_subset).otherwise(F.lit("")),
        F.lit("}"),
    )
    allowed = F.when(F.col("allowed"), F.lit("allowed=True")).otherwise(F.lit("allowed=False"))
    all_lines = F.concat(F.array(allowed), lines("errors", "ERROR "), lines("warnings", "WARN  "), F.array(context))
    return decisions.select("model_name", F.posexplode(all_lines).alias("line_no", "line"))


def exit_status(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        "model_name", F.when(F.col("allowed"), F.lit(0)).otherwise(F.lit(2)).alias("exit_status")
    )


def block_report(decisions: DataFrame, group: Column) -> DataFrame:
    """Models per error code and group, with subtotals per group and in total."""
    blocked = decisions.select(group.alias("model_group"), F.explode("errors").alias("v"))
    return (
        blocked.rollup("model_group", F.col("v.code").alias("code"))
        .agg(F.count(F.lit(1)).alias("models"), F.grouping_id().cast("int").alias("level"))
        .select("model_group", "code", "level", "models")
    )
