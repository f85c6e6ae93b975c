"""Request ids, body checks, canary buckets, routing, and serving of whole request tables or streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relyard import constants as c
from relyard.functions.columns import with_once
from relyard.functions.hashing import bucket_of_digest, canonical_json, sha256_text
from relyard.functions.scoring import mean_abs_diff, probabilities
from relyard.functions.text import strip_or_null
from relyard.operators.ordered import lookup_join

MODES = (c.PROD, c.CANDIDATE, c.SHADOW, c.CANARY)


def assign_request_ids(requests: DataFrame) -> DataFrame:
    """Trimmed client id, or one derived from the log key: a recomputed task gives the same id again."""
    client = strip_or_null(F.col("client_request_id"))
    return requests.withColumn("client_provided", client.isNotNull()).withColumn(
        "request_id", F.coalesce(client, F.md5(F.concat(F.lit("request:"), F.col("event_id"))))
    )


ROWS = "$.rows"


def parse_bodies(requests: DataFrame) -> DataFrame:
    """Add ``document`` (variant), ``features`` and ``body_error``: null when rows is a list of objects.

    One cast does the checking: what is no list becomes null, and so does an item that is no object. The
    finer reasons are looked up only for bodies that failed it.
    """
    parsed = with_once(requests, document=F.try_parse_json("body"))
    cast = with_once(parsed, features=F.try_variant_get("document", ROWS, "array<map<string,double>>"))
    bad_item = F.exists("features", lambda item: item.isNull())
    error = (
        F.when(F.col("features").isNotNull(), F.when(bad_item, F.lit("row_not_object")))
        .when(F.col("document").isNull(), F.lit("invalid_json"))
        .when(F.try_variant_get("document", ROWS, "variant").isNull(), F.lit("missing_rows"))
        .otherwise(F.lit("rows_not_list"))
    )
    return with_once(cast, body_error=error)


# Bodies whose canonical text the built-in form could print differently: fractions and exponents, numbers beyond 18 digits,
# minus zero, escapes, and text beyond ASCII.
NOT_PLAIN = r"[0-9][.eE]|[0-9]{19}|-0|\\|[^\x00-\x7F]"


def canonical_rows(wanted: Column | None = None) -> Column:
    """Compact JSON of the rows with sorted keys, as Python's ``json.dumps`` prints it; null where not ``wanted``.

    A variant keeps object keys sorted, so printing it is the canonical form of integers, booleans and plain text. The
    other bodies go through an Arrow function, and only they: it gets null for every other row.
    """
    here = F.col("body_error").isNull() if wanted is None else wanted & F.col("body_error").isNull()
    plain = ~F.col("body").rlike(NOT_PLAIN)
    exact = canonical_json(F.when(here & ~plain, F.col("body")), "rows")
    return F.when(here, F.when(plain, F.to_json(F.try_variant_get("document", ROWS, "variant"))).otherwise(exact))


def canary_seed(requests: DataFrame, needed: Column | None = None) -> DataFrame:
    """Seed and its source: client id, else payload, else the assigned id (repeatable, unlike a new uuid).

    Where ``needed`` is false both stay null and the payload is not rendered.
    """
    wanted = F.lit(True) if needed is None else needed
    by_client, by_payload = F.col("client_provided"), F.col("body_error").isNull()
    seed = F.when(by_client | ~by_payload, F.col("request_id")).otherwise(canonical_rows(wanted & ~by_client))
    source = F.when(by_client, F.lit("request_id")).when(by_payload, F.lit("payload_hash")).otherwise(F.lit("random"))
    return requests.withColumns({"seed": F.when(wanted, seed), "seed_source": F.when(wanted, source)})


def route(requests: DataFrame, canary_pct: int | Column = c.CANARY_PCT) -> DataFrame:
    """Add chosen, run_shadow and route_error from ``mode`` and ``bucket``.

    A bad mode or bucket marks its own row instead of failing the job.
    """
    pct = F.lit(canary_pct) if isinstance(canary_pct, int) else canary_pct
    pct = F.least(F.lit(100), F.greatest(F.lit(0), pct))
    mode, bucket = F.col("mode"), F.coalesce("bucket", F.lit(0))
    error = (
        F.when(~bucket.between(0, 99), F.concat(F.lit("no bucket from 0 to 99: "), bucket))
        .when(mode.isNull() | ~mode.isin(*MODES), F.concat(F.lit("no route for mode "), F.coalesce(mode, F.lit(""))))
    )
    to_candidate = (mode == c.CANDIDATE) | ((mode == c.CANARY) & (bucket < pct))
    return (
        requests.withColumn("route_error", error)
        .withColumn(
            "chosen",
            F.when(F.col("route_error").isNull(), F.when(to_candidate, F.lit(c.CANDIDATE)).otherwise(F.lit(c.PROD))),
        )
        .withColumn("run_shadow", F.when(F.col("route_error").isNull(), mode.isin(c.SHADOW, c.CANARY)))
    )


def prepare(requests: DataFrame, canary_pct: int = c.CANARY_PCT) -> DataFrame:
    """Ids, body check, seed, bucket and route of every prediction request; narrow, no shuffle."""
    predict = requests.filter(F.col("endpoint") == "/predict")
    is_canary = F.col("mode") == c.CANARY
    seeded = canary_seed(parse_bodies(assign_request_ids(predict)), needed=is_canary)
    hashed = with_once(seeded, _digest=sha256_text(F.col("seed")))
    routed = route(with_once(hashed, bucket=bucket_of_digest(F.col("_digest"))), canary_pct)
    return routed.withColumn("canary_pct", F.when(is_canary, F.lit(canary_pct))).drop("document", "seed", "_digest")


def serving_models(aliases: DataFrame, coefficients: DataFrame) -> DataFrame:
    """One row per model: prod and candidate versions with their coefficients."""
    live = aliases.filter(F.col("alias").isin(c.PROD, c.CANDIDATE)).join(
        coefficients, ["model_name", "version"], "left"
    )

    def pick(alias: str, column: str) -> Column:
        return F.any_value(F.when(F.col("alias") == alias, F.col(column)), True)

    return live.groupBy("model_name").agg(
        pick(c.PROD, "version").alias("prod_version"),
        pick(c.PROD, "model").alias("prod_model"),
        pick(c.CANDIDATE, "version").alias("candidate_version"),
        pick(c.CANDIDATE, "model").alias("candidate_model"),
    )


def serve(requests: DataFrame, serving: DataFrame, canary_pct: int = c.CANARY_PCT, serving_bytes: int | None = None) -> DataFrame:
    """Score every prediction request with its chosen model and, where asked, with the other one.

    Both scores are computed on the same row, so the log is read once and never joined to itself. The
    model lookup moves no request while the table of served models is small, and spreads hot models
    otherwise; ``serving_bytes`` is its size where that has been measured before.
    """
    prepared = prepare(requests, canary_pct)
    joined = lookup_join(prepared, serving, ["model_name"], ["event_id"], lookup_bytes=serving_bytes)
    is_prod = F.col("chosen") == c.PROD
    valid = F.col("body_error").isNull() & F.col("route_error").isNull()
    primary = F.when(is_prod, F.col("prod_model")).otherwise(F.col("candidate_model"))
    other = F.when(is_prod, F.col("candidate_model")).otherwise(F.col("prod_model"))
    scored = with_once(
        joined,
        proba=F.when(valid, probabilities(primary, F.col("features"))),
        shadow_proba=F.when(valid & F.col("run_shadow"), probabilities(other, F.col("features"))),
    )
    failed = F.exists("proba", lambda p: p.isNull())
    status = (
        F.when(~valid, F.lit(422))
        .when(F.col("proba").isNull(), F.lit(503))
        .when(failed, F.lit(500))
        .otherwise(F.lit(200))
    )
    ok = F.col("status") == 200
    return (
        scored.withColumn("status", status)
        .withColumn("proba", F.when(ok, F.col("proba")))
        .withColumn("shadow_mae", F.when(ok, mean_abs_diff(F.col("proba"), F.col("shadow_proba"))))
        .drop("prod_model", "candidate_model", "shadow_proba")
    )


def primary_scores(served: DataFrame) -> DataFrame:
    """One row per scored feature row."""
    version = F.when(F.col("chosen") == c.PROD, F.col("prod_version")).otherwise(F.col("candidate_version"))
    return served.filter(F.col("status") == 200).select(
        "event_id", "model_name", "chosen", version.alias("version"), F.posexplode("proba").alias("row_pos", "proba")
    )
