"""Streaming queries: each must give what the batch query gives on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relyard import constants as c
from relyard.operators import routing, serving_log
from relyard.plans.catalog import query
from relyard.plans.oracle_views import sql
from relyard.plans.serving_plans import BOUNDS_SQL, PREDICT_LOG_SQL
from relyard.session import new_location
from relyard.sources import views
from relyard.sources.tables import table
from relyard.streaming import as_of, jobs

_LABELS = """endpoint, CASE WHEN endpoint <> '/predict' THEN '' WHEN mode IN ('prod', 'candidate', 'shadow', 'canary') THEN mode ELSE 'invalid' END AS mode, status"""


def served_stream(spark: SparkSession, sf: str) -> DataFrame:
    serving = routing.serving_models(views.aliases(spark, sf), views.coefficients(spark, sf))
    return routing.serve(jobs.request_stream(spark, sf), serving)


@query(
    "stream_requests_total",
    sql(
        f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, {_LABELS}, count(*) AS requests
        FROM rq WHERE endpoint <> '/metrics' GROUP BY ALL""",
        "rq",
    ),
)
def stream_requests_total(spark: SparkSession, sf: str) -> DataFrame:
    counts = jobs.windowed_requests(jobs.request_stream(spark, sf), "1 day")
    return jobs.started(jobs.windows_to(counts, new_location(spark, "stream-requests")))


@query(
    "stream_requests_sliding",
    sql(
        f"""SELECT strftime(start, '%Y-%m-%d %H:%M') AS window_start, {_LABELS}, count(*) AS requests
        FROM (SELECT *, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS start
              FROM rq WHERE endpoint <> '/metrics') GROUP BY ALL""",
        "rq",
    ),
)
def stream_requests_sliding(spark: SparkSession, sf: str) -> DataFrame:
    counts = jobs.windowed_requests(jobs.request_stream(spark, sf), "24 hours", "12 hours")
    return jobs.started(jobs.windows_to(counts, new_location(spark, "stream-requests")))


@query(
    "stream_latency_histogram",
    sql(
        f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, mode, status, chosen, pos, le, count(*) FILTER (latency_s <= bound) AS cumulative_count
        FROM sv, {BOUNDS_SQL} WHERE status <> 422 GROUP BY ALL""",
        "sv",
    ),
)
def stream_latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    cells = jobs.windowed_latency(served_stream(spark, sf), "1 day")
    keys = ["window_start", "mode", "status", "chosen"]
    return serving_log.accumulate(jobs.started(jobs.windows_to(cells, new_location(spark, "stream-latency"))), keys)


@query(
    "stream_shadow_mae",
    sql(
        """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, mode, count(*) AS requests, round(avg(shadow_mae), 6) AS shadow_mae,
        avg(shadow_mae) > 0.3 AS alert FROM sv WHERE shadow_mae IS NOT NULL GROUP BY ALL""",
        "sv",
    ),
)
def stream_shadow_mae(spark: SparkSession, sf: str) -> DataFrame:
    compared = jobs.windowed_shadow_mae(served_stream(spark, sf), "1 day")
    return jobs.shadow_alert(jobs.started(jobs.windows_to(compared, new_location(spark, "stream-mae"))), 0.3)


@query("stream_dedup_requests", sql("SELECT DISTINCT request_id FROM rp WHERE client_provided", "rp"))
def stream_dedup_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Retries of one client id arrive up to a month apart here, so the delay covers the whole log."""
    requests = jobs.request_stream(spark, sf).filter(F.col("endpoint") == "/predict")
    client = routing.assign_request_ids(requests).filter("client_provided").select("request_id", "ts")
    first = jobs.deduplicated(client, "40 days").select("request_id")
    return jobs.append_to(first, new_location(spark, "stream-dedup"))


@query("stream_predict_log", PREDICT_LOG_SQL)
def stream_predict_log(spark: SparkSession, sf: str) -> DataFrame:
    log = serving_log.predict_log(served_stream(spark, sf))
    stored = jobs.append_to(log, new_location(spark, "stream-log"))
    return stored.withColumn("shadow_mae", F.round("shadow_mae", 6))


@query(
    "stream_alias_refresh",
    sql(
        """SELECT mode, chosen, CASE WHEN chosen = 'prod' THEN prod_version ELSE candidate_version END AS version, count(*) AS requests
        FROM sv WHERE status = 200 GROUP BY ALL""",
        "sv",
    ),
)
def stream_alias_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Requests per served version, with the stored alias table read again for each micro-batch."""
    path = new_location(spark, "stream-refresh")
    views.aliases(spark, sf).write.parquet(f"{path}/aliases")
    log = jobs.serve_with_refresh(
        jobs.request_stream(spark, sf), path, lambda: spark.read.parquet(f"{path}/aliases"), views.coefficients(spark, sf)
    )
    version = F.when(F.col("chosen") == c.PROD, F.col("prod_version")).otherwise(F.col("candidate_version"))
    return log.groupBy("mode", "chosen", version.alias("version")).agg(F.count(F.lit(1)).alias("requests"))


def _alias_events(orders: DataFrame) -> DataFrame:
    """Alias events of orders as a stream or a table; the order key stands for the version."""
    names = F.array_compact(F.array(F.lit(c.CANDIDATE), F.when(F.col("o_orderstatus") != "P", F.lit(c.PROD))))
    return orders.select(
        F.concat(F.lit("m"), F.col("o_custkey")).alias("model_name"),
        F.explode(names).alias("alias"),
        F.col("o_orderkey").alias("version"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
    )


@query(
    "stream_alias_state",
    """SELECT concat('m', o_custkey) AS model_name, 'candidate' AS alias, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY o_custkey
    UNION ALL SELECT concat('m', o_custkey), 'prod', max_by(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey""",
)
def stream_alias_state(spark: SparkSession, sf: str) -> DataFrame:
    """Alias table kept up to date from a stream of alias events."""
    return jobs.alias_state(_alias_events(jobs.stream_table(spark, sf, "orders")), new_location(spark, "stream-alias"))


@query(
    "stream_alias_as_of",
    """SELECT p.model_name, e.version, count(*) AS items
    FROM (SELECT concat('m', o_custkey) AS model_name, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey) p
    LEFT JOIN (SELECT concat('m', o_custkey) AS model_name, o_orderkey AS version, o_orderdate AS ts,
        lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS till
      FROM orders WHERE o_orderstatus IN ('F', 'O')) e
      ON e.model_name = p.model_name AND p.ts >= e.ts AND (p.ts < e.till OR e.till IS NULL)
    GROUP BY ALL""",
)
def stream_alias_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Which version was prod when each item shipped, from a stream of items and one of alias events.

    The first run reads both tables and keeps what the watermark has not passed; the second runs on from its state with a heartbeat
    in both streams, which answers the rest.
    """
    path = new_location(spark, "stream-as-of")
    beats = f"{path}/heartbeats"
    spark.createDataFrame([], "ts timestamp").write.parquet(beats)
    beat = lambda names: [F.lit(None).cast(t).alias(n) for n, t in names]

    def run() -> DataFrame:
        heartbeat = spark.readStream.schema("ts timestamp").parquet(beats)
        owner = views.orders(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("m"), F.col("o_custkey")).alias("model_name"))
        items = jobs.stream_table(spark, sf, "lineitem").join(owner, "l_orderkey").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), "model_name", F.lit(c.PROD).alias("alias"), jobs.event_time(F.col("l_shipdate")).alias("ts")
        )
        items = items.union(heartbeat.select(*beat([("request_id", "bigint"), ("model_name", "string"), ("alias", "string")]), "ts"))
        events = _alias_events(jobs.stream_table(spark, sf, "orders")).where(F.col("alias") == c.PROD).withColumn("ts", jobs.event_time(F.col("ts")))
        quiet = heartbeat.select(*beat([("model_name", "string"), ("alias", "string"), ("version", "bigint")]), "ts", *beat([("seq", "bigint")]))
        return as_of.answer_to(items, events.union(quiet), path, "1 hour", salts=2)

    run()
    spark.sql("SELECT TIMESTAMP '2100-01-01 00:00:00Z' AS ts").write.mode("append").parquet(beats)
    return run().groupBy("model_name", "version").agg(F.count(F.lit(1)).alias("items"))


@query(
    "stream_sessions",
    sql(
        """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS requests
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid
              FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events))
        GROUP BY user_id, sid HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""",
    ),
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.append_to(jobs.sessions(jobs.request_stream(spark, sf)), new_location(spark, "stream-sessions"), jobs.SESSION_SETTINGS)


@query(
    "stream_late_rows",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS requests FROM events
    WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY date_trunc('day', ts)
    HAVING date_trunc('day', ts) + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""",
)
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The second half of the log arrives first; the first half then comes past the watermark and is late.

    The job runs twice from one checkpoint, as a restarted stream does. Only closed days are written.
    """
    path = new_location(spark, "stream-late")
    events = table(spark, sf, "events").select("event_id", jobs.event_time(F.col("ts")).alias("ts"))
    recent = F.col("ts") >= F.lit("2024-01-16 00:00:00Z").cast("timestamp")
    events.filter(recent).write.parquet(f"{path}/landing")
    landing = spark.readStream.schema(events.schema).parquet(f"{path}/landing")
    daily = (
        landing.withWatermark("ts", jobs.WATERMARK)
        .groupBy(F.window("ts", "1 day").alias("window"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(jobs.window_start(), "requests")
    )
    jobs.append_to(daily, path)
    events.filter(~recent).write.mode("append").parquet(f"{path}/landing")
    return jobs.append_to(daily, path)
