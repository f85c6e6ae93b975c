"""Request, routing, scoring and log queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from relyard import constants as c
from relyard.functions.hashing import bucket_of, canonical_json
from relyard.functions.scoring import label_of, probabilities
from relyard.operators import evaluation, registry, routing, serving_log
from relyard.operators.ordered import lookup_join
from relyard.plans.catalog import query
from relyard.plans.oracle_views import sql
from relyard.plans.policy_plans import decisions
from relyard.session import new_location
from relyard.sources import tables, views

_BUCKET = """CAST((76 * (('0x' || substr(h, 1, 4))::BIGINT % 100 + ('0x' || substr(h, 5, 15))::BIGINT % 100
 + ('0x' || substr(h, 20, 15))::BIGINT % 100 + ('0x' || substr(h, 35, 15))::BIGINT % 100) + ('0x' || substr(h, 50, 15))::BIGINT % 100) % 100 AS INTEGER)"""


def served(spark: SparkSession, sf: str) -> DataFrame:
    serving = routing.serving_models(views.aliases(spark, sf), views.coefficients(spark, sf))
    return routing.serve(views.requests(spark, sf), serving)


def _predict_requests(spark: SparkSession, sf: str) -> DataFrame:
    predict = views.requests(spark, sf).filter(F.col("endpoint") == "/predict")
    return routing.parse_bodies(routing.assign_request_ids(predict))


@query(
    "bucket_request_id",
    sql(f"SELECT event_id, request_id, {_BUCKET} AS bucket FROM (SELECT *, sha256(request_id) AS h FROM rp WHERE client_provided)", "rp"),
)
def bucket_request_id(spark: SparkSession, sf: str) -> DataFrame:
    requests = _predict_requests(spark, sf).filter("client_provided")
    return requests.select("event_id", "request_id", bucket_of(F.col("request_id")).alias("bucket"))


_PAYLOAD_SQL = sql(
    f"SELECT event_id, rows_text, {_BUCKET} AS bucket FROM (SELECT *, sha256(rows_text) AS h FROM rp WHERE rows_text IS NOT NULL)", "rp"
)


@query("bucket_payload", _PAYLOAD_SQL)
def bucket_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = _predict_requests(spark, sf).filter(F.col("body_error").isNull())
    text = rows.select("event_id", routing.canonical_rows().alias("rows_text"))
    return text.select("event_id", "rows_text", bucket_of(F.col("rows_text")).alias("bucket"))


@query("bucket_payload_any_number", _PAYLOAD_SQL)
def bucket_payload_any_number(spark: SparkSession, sf: str) -> DataFrame:
    """The same, all through the Arrow function that renders any number exactly."""
    rows = _predict_requests(spark, sf).filter(F.col("body_error").isNull())
    text = rows.select("event_id", canonical_json(F.col("body"), "rows").alias("rows_text"))
    return text.select("event_id", "rows_text", bucket_of(F.col("rows_text")).alias("bucket"))


@query(
    "canary_seed",
    sql(
        """SELECT event_id, CASE WHEN client_provided THEN request_id ELSE coalesce(rows_text, request_id) END AS seed,
        CASE WHEN client_provided THEN 'request_id' WHEN rows_text IS NOT NULL THEN 'payload_hash' ELSE 'random' END AS seed_source FROM rp""",
        "rp",
    ),
)
def canary_seed(spark: SparkSession, sf: str) -> DataFrame:
    return routing.canary_seed(_predict_requests(spark, sf)).select("event_id", "seed", "seed_source")


@query(
    "request_id_assign",
    sql(
        """SELECT event_id, coalesce(trim(client_request_id), md5(concat('request:', event_id))) AS request_id,
        client_request_id IS NOT NULL AS client_provided FROM rq""",
        "rq",
    ),
)
def request_id_assign(spark: SparkSession, sf: str) -> DataFrame:
    return routing.assign_request_ids(views.requests(spark, sf)).select("event_id", "request_id", "client_provided")


@query("request_validation", sql("SELECT event_id, body_error IS NULL AS valid, body_error FROM rp", "rp"))
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    checked = _predict_requests(spark, sf)
    return checked.select("event_id", F.col("body_error").isNull().alias("valid"), "body_error")


@query(
    "route_requests",
    sql(
        """SELECT event_id, mode, bucket, seed_source, chosen, run_shadow,
        CASE WHEN chosen IS NULL THEN concat('no route for mode ', mode) END AS route_error FROM rt""",
        "rt",
    ),
)
def route_requests(spark: SparkSession, sf: str) -> DataFrame:
    routed = routing.prepare(views.requests(spark, sf))
    return routed.select("event_id", "mode", "bucket", "seed_source", "chosen", "run_shadow", "route_error")


@query(
    "canary_share",
    sql(
        """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (chosen = 'candidate') AS to_candidate,
        10 AS canary_pct, round(count(*) FILTER (chosen = 'candidate') / count(*), 6) AS share FROM rt WHERE mode = 'canary' GROUP BY 1""",
        "rt",
    ),
)
def canary_share(spark: SparkSession, sf: str) -> DataFrame:
    return serving_log.canary_share(routing.prepare(views.requests(spark, sf)))


@query(
    "canary_buckets",
    sql(
        """SELECT *, (100 * sum(requests * requests) OVER d - (sum(requests) OVER d) * (sum(requests) OVER d)) * 10 > 1482 * sum(requests) OVER d AS uneven_day
        FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, bucket, count(*) AS requests, count(*) FILTER (chosen = 'candidate') AS to_candidate,
          bool_and((chosen = 'candidate') = (bucket < 10)) AS as_routed FROM rt WHERE mode = 'canary' GROUP BY 1, 2) WINDOW d AS (PARTITION BY day)""",
        "rt",
    ),
)
def canary_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return serving_log.canary_buckets(routing.prepare(views.requests(spark, sf)))


@query(
    "canary_stickiness",
    sql(
        """SELECT request_id, count(*) AS requests, min(bucket) AS bucket, min(bucket) = max(bucket) AND min(chosen) = max(chosen) AS sticky
        FROM rt WHERE mode = 'canary' AND client_provided GROUP BY 1""",
        "rt",
    ),
)
def canary_stickiness(spark: SparkSession, sf: str) -> DataFrame:
    return serving_log.canary_stickiness(routing.prepare(views.requests(spark, sf)))


@query(
    "primary_scores",
    sql(
        """SELECT event_id, model_name, chosen, version, row_pos, round(p, 6) AS proba FROM (
        SELECT event_id, model_name, chosen, version, 0 AS row_pos, p0 AS p FROM sv WHERE status = 200 AND n > 0
        UNION ALL SELECT event_id, model_name, chosen, version, 1, p1 FROM sv WHERE status = 200 AND n > 0)""",
        "sv",
    ),
)
def primary_scores(spark: SparkSession, sf: str) -> DataFrame:
    return routing.primary_scores(served(spark, sf)).withColumn("proba", F.round("proba", 6))


@query(
    "shadow_mae",
    sql("SELECT event_id, mode, chosen, round(shadow_mae, 6) AS shadow_mae FROM sv WHERE status = 200 AND run_shadow", "sv"),
)
def shadow_mae(spark: SparkSession, sf: str) -> DataFrame:
    compared = served(spark, sf).filter((F.col("status") == 200) & F.col("run_shadow"))
    return compared.select("event_id", "mode", "chosen", F.round("shadow_mae", 6).alias("shadow_mae"))


PREDICT_LOG_SQL = sql(
    """SELECT 'predict' AS event, request_id, mode, chosen, status, CAST(trunc(latency_s * 1000) AS BIGINT) AS latency_ms, bucket,
    seed_source AS bucket_seed_source, canary_pct, round(shadow_mae, 6) AS shadow_mae, prod_version, candidate_version FROM sv WHERE status = 200""",
    "sv",
)


@query("predict_log", PREDICT_LOG_SQL)
def predict_log(spark: SparkSession, sf: str) -> DataFrame:
    return serving_log.predict_log(served(spark, sf)).withColumn("shadow_mae", F.round("shadow_mae", 6))


@query("predict_log_by_day", PREDICT_LOG_SQL.replace("'predict' AS event,", "'predict' AS event, strftime(ts, '%Y-%m-%d') AS day,"))
def predict_log_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """The log appended in two batches, one of which came twice, in folders by day."""
    path = new_location(spark, "predict-log")
    both = served(spark, sf)
    log = serving_log.predict_log(both, F.date_format("ts", "yyyy-MM-dd").alias("day"))
    parts = {"odd": F.col("event_id") % 2 == 1, "even": F.col("event_id") % 2 == 0}
    for batch in ("odd", "even", "odd"):
        part = serving_log.predict_log(both.where(parts[batch]), F.date_format("ts", "yyyy-MM-dd").alias("day"))
        tables.log_batch(part, path, "day", batch)
    stored = spark.read.schema(StructType([*log.schema.fields, StructField("batch", StringType())])).parquet(path)
    return stored.drop("batch").withColumn("shadow_mae", F.round("shadow_mae", 6))


@query(
    "predict_response",
    sql(
        """SELECT request_id, mode, n, CASE WHEN n = 0 THEN '' ELSE concat(CAST(round(p0, 4) AS DECIMAL(6, 4)), ',', CAST(round(p1, 4) AS DECIMAL(6, 4))) END AS proba,
        chosen, bucket, canary_pct, seed_source AS bucket_seed_source FROM sv WHERE status = 200""",
        "sv",
    ),
)
def predict_response(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.transform("proba", lambda p: F.round(p, 4).cast("decimal(6,4)").cast("string"))
    return serving_log.predict_response(served(spark, sf)).withColumn("proba", F.array_join(shown, ","))


@query("request_status", sql("SELECT event_id, mode, chosen, status FROM sv", "sv"))
def request_status(spark: SparkSession, sf: str) -> DataFrame:
    return served(spark, sf).select("event_id", "mode", "chosen", "status")


@query(
    "score_range_check",
    sql("SELECT event_id, n, true AS in_range, true AS one_per_row FROM sv WHERE status = 200", "sv"),
)
def score_range_check(spark: SparkSession, sf: str) -> DataFrame:
    answered = served(spark, sf).filter(F.col("status") == 200)
    checked = evaluation.score_range(answered, "features", "proba")
    return checked.select("event_id", F.size("proba").alias("n"), "in_range", "one_per_row")


@query(
    "requests_total",
    sql(
        """SELECT endpoint, CASE WHEN endpoint <> '/predict' THEN '' WHEN mode IN ('prod', 'candidate', 'shadow', 'canary') THEN mode ELSE 'invalid' END AS mode,
        status, count(*) AS requests FROM rq WHERE endpoint <> '/metrics' GROUP BY ALL""",
        "rq",
    ),
)
def requests_total(spark: SparkSession, sf: str) -> DataFrame:
    return serving_log.requests_total(views.requests(spark, sf))


BOUNDS_SQL = "(VALUES " + ", ".join(
    f"({i}, '{label}', {'1e308' if label == '+Inf' else label + 'e0'})" for i, label in enumerate(serving_log.le_labels())
) + ") b(pos, le, bound)"


@query(
    "latency_histogram",
    sql(
        f"""SELECT mode, status, chosen, pos, le, count(*) FILTER (latency_s <= bound) AS cumulative_count
        FROM sv, {BOUNDS_SQL} WHERE status <> 422 GROUP BY ALL""",
        "sv",
    ),
)
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return serving_log.latency_histogram(served(spark, sf))


@query(
    "latency_sums",
    sql(
        """SELECT mode, status, chosen, count(*) AS observations, round(sum(latency_s), 6) AS latency_sum
        FROM sv WHERE status <> 422 GROUP BY ALL""",
        "sv",
    ),
)
def latency_sums(spark: SparkSession, sf: str) -> DataFrame:
    return serving_log.latency_sums(served(spark, sf))


@query(
    "shadow_mae_histogram",
    sql(
        f"""SELECT mode, pos, le, count(*) FILTER (shadow_mae <= bound) AS cumulative_count
        FROM sv, {BOUNDS_SQL} WHERE shadow_mae IS NOT NULL GROUP BY ALL""",
        "sv",
    ),
)
def shadow_mae_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return serving_log.shadow_mae_histogram(served(spark, sf))


@query("latency_quantiles")
def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return serving_log.latency_quantiles(served(spark, sf))


@query(
    "histogram_quantile",
    sql(
        f"""SELECT mode, 0.95e0 AS quantile, round(CASE WHEN pos = 14 THEN lo ELSE lo + (bound - lo) * (0.95e0 * total - below) / (cum - below) END, 6) AS value
        FROM (SELECT *, max(cum) OVER (PARTITION BY mode) AS total, coalesce(lag(cum) OVER w, 0) AS below, coalesce(lag(bound) OVER w, 0) AS lo
              FROM (SELECT mode, pos, bound, count(*) FILTER (latency_s <= bound) AS cum FROM sv, {BOUNDS_SQL} WHERE status <> 422 GROUP BY ALL)
              WINDOW w AS (PARTITION BY mode ORDER BY pos))
        WHERE cum >= 0.95e0 * total AND (below < 0.95e0 * total)""",
        "sv",
    ),
)
def histogram_quantile(spark: SparkSession, sf: str) -> DataFrame:
    observed = serving_log.observed_latency(served(spark, sf))
    buckets = serving_log.histogram(observed, ["mode"], "latency_s")
    return serving_log.histogram_quantile(buckets, ["mode"], 0.95)


@query(
    "release_scorecard",
    sql(
        """SELECT t.*, error_codes = '' AS allowed, error_codes FROM (
          SELECT model_name, count(*) AS requests, count(*) FILTER (status = 200 AND chosen = 'prod') AS prod_requests,
            count(*) FILTER (status = 200 AND chosen = 'candidate') AS candidate_requests,
            round(count(*) FILTER (status >= 500) / count(*), 6) AS error_share, round(avg(shadow_mae), 6) AS shadow_mae
          FROM sv GROUP BY model_name) t LEFT JOIN pol ON pol.model_name = t.model_name""",
        "sv", "pol",
    ),
)
def release_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return serving_log.release_scorecard(served(spark, sf), decisions(spark, sf))


# --- models as data over the dataset ----------------------------------------------------------------


def _feature_map() -> Column:
    return F.create_map(F.lit("k"), F.col("f2") * 4, F.lit("v"), F.col("f1") / 200)


_DATASET_SCORES = """SELECT row_id, m.model_name, co.version,
 1 / (1 + exp(-(intercept + w_k * ((f2 * 4 - 50) / 25e0) + w_v * ((f1 / 200 - 25) / sd_v)))) AS p
FROM ds JOIN (SELECT o_orderkey, concat('m', o_custkey) AS model_name FROM orders) m ON m.o_orderkey = ds.row_id
{join}"""


@query(
    "score_proba",
    sql(
        "SELECT row_id, model_name, version, round(p, 6) AS proba FROM ("
        + _DATASET_SCORES.format(join="JOIN md ON md.model_name = m.model_name JOIN co ON co.model_name = md.model_name AND co.version = md.newest")
        + ")",
        "ds", "md", "co",
    ),
)
def score_proba(spark: SparkSession, sf: str) -> DataFrame:
    """Each dataset row scored by the newest version of its model."""
    newest = views.models(spark, sf).select("model_name", F.col("newest").alias("version"))
    models = newest.join(views.coefficients(spark, sf), ["model_name", "version"])
    rows = lookup_join(views.owned_dataset(spark, sf), models, ["model_name"], ["row_id"], how="inner")
    p = probabilities(F.col("model"), F.array(_feature_map()))[0]
    return rows.select("row_id", "model_name", "version", F.round(p, 6).alias("proba"))


_BY_REF = _DATASET_SCORES.format(
    join="""LEFT JOIN al ON al.model_name = m.model_name AND al.alias = CASE WHEN target = 1 THEN 'prod' ELSE 'candidate' END
LEFT JOIN co ON co.model_name = al.model_name AND co.version = al.version"""
)


@query(
    "score_by_ref",
    sql(
        "SELECT row_id, uri, version, round(p, 6) AS proba FROM (SELECT s.*, concat('models:/', model_name, CASE WHEN target = 1 THEN '@prod' ELSE '@candidate' END) AS uri FROM ("
        + _BY_REF + ") s JOIN ds USING (row_id))",
        "ds", "al", "co",
    ),
)
def score_by_ref(spark: SparkSession, sf: str) -> DataFrame:
    """Rows name their model by URI; references are resolved once each, then scored in one pass."""
    alias = F.when(F.col("target") == 1, F.lit("@prod")).otherwise(F.lit("@candidate"))
    rows = views.owned_dataset(spark, sf).withColumn("uri", F.concat(F.lit("models:/"), F.col("model_name"), alias))
    versions = views.model_versions(spark, sf).select("model_name", "version", "source_run_id")
    refs = registry.resolve_refs(rows.select("uri").distinct(), views.aliases(spark, sf), versions, views.runs(spark, sf))
    models = refs.select("uri", "model_name", "version").join(
        views.coefficients(spark, sf), ["model_name", "version"], "left"
    )
    joined = lookup_join(rows.drop("model_name"), models, ["uri"], ["row_id"])
    p = probabilities(F.col("model"), F.array(_feature_map()))[0]
    return joined.select("row_id", "uri", "version", F.round(p, 6).alias("proba"))


@query(
    "threshold_label",
    sql("SELECT model_name, CASE WHEN score >= 0.5e0 THEN 1 WHEN score < 0.5e0 THEN 0 END AS predicted, count(*) AS n FROM sb GROUP BY ALL", "sb"),
)
def threshold_label(spark: SparkSession, sf: str) -> DataFrame:
    predicted = label_of(F.col("score"), c.DECISION_THRESHOLD).alias("predicted")
    return views.scores_big(spark, sf).groupBy("model_name", predicted).agg(F.count(F.lit(1)).alias("n"))
