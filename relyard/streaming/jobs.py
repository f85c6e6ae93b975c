"""Structured Streaming forms: windowed counters and histograms, de-duplication, serving, alias state.

Each job runs to the end of what is there (``availableNow``) and starts again from its checkpoint, so the
same code serves a scheduled catch-up and, with another trigger, a live stream. Sinks are idempotent: parquet with a checkpoint in
append mode, one folder per batch id where a batch handler writes; open windows and alias state are read from the state store. A run
that finds nothing new returns what is there. No job leaves a changed setting in the caller's session.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from relyard import constants as c
from relyard.functions.histogram import bucket_index
from relyard.operators import routing, serving_log
from relyard.operators.ordered import estimated_bytes
from relyard.sources.tables import table
from relyard.sources.views import requests_from

WATERMARK = "1 hour"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table as a stream; braces make the path a pattern, which fits a file and a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{{{name}}}.parquet")


def event_time(ts: Column) -> Column:
    """A time without zone as the UTC instant that watermarks need, whatever the session's time zone."""
    return F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")


def wall_minute(ts: Column) -> Column:
    """The UTC text of an instant up to the minute, whatever the session's time zone."""
    return _wall_day(ts, F.format_string("%02d:%02d", _of_day(ts, 3600), _of_day(ts, 60) % 60))


def wall_second(ts: Column) -> Column:
    return _wall_day(ts, F.format_string("%02d:%02d:%02d", _of_day(ts, 3600), _of_day(ts, 60) % 60, _of_day(ts, 1) % 60))


def _of_day(ts: Column, seconds: int) -> Column:
    return F.floor(F.pmod(F.unix_seconds(ts), F.lit(86400)) / seconds)


def _wall_day(ts: Column, clock: Column) -> Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(ts) / 86400).cast("int"))
    return F.concat_ws(" ", day.cast("string"), clock)


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from(stream_table(spark, sf_dir, "events")).withColumn("ts", event_time(F.col("ts")))


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for as long as a job runs; the caller's own come back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def append_to(stream: DataFrame, path: str, conf: Mapping[str, str] | None = None) -> DataFrame:
    """Run an append-mode stream into parquet and return what it has written so far."""
    with settings(stream.sparkSession, conf or {}):
        job = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/rows")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def state_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the aggregation of a checkpointed stream holds after its last batch: grouping columns, then one buffer per measure."""
    empty = spark.createDataFrame([], schema)
    try:
        held = spark.read.format("statestore").load(f"{path}/checkpoint")
    except AnalysisException as error:
        if "NO_COMMITTED_BATCH" in (error.getCondition() or ""):
            return empty
        raise
    return held.select("key.*", "value.*").toDF(*schema.names).select(*[F.col(f.name).cast(f.dataType) for f in schema])


def windows_to(grouped: DataFrame, path: str) -> DataFrame:
    """Run a windowed aggregation and return its rows: closed windows from the log, open ones from the state.

    A window is written once, when the watermark has passed it; until then it lives in the state alone. So a batch writes what it
    closes, and what is read grows with the windows and not with the batches.
    """
    closed = append_to(grouped, path)
    return closed.unionByName(state_rows(grouped.sparkSession, path, grouped.schema))


def window_start(name: str = "window") -> Column:
    return wall_minute(F.col(f"{name}.start")).alias("window_start")


def windowed_requests(requests: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Request counter per event-time window; counts are combined before the shuffle."""
    counted = serving_log.counted(requests).withWatermark("ts", WATERMARK)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return counted.groupBy(window.alias("window"), "endpoint", "mode", "status").agg(F.count(F.lit(1)).alias("requests"))


def windowed_latency(served: DataFrame, length: str) -> DataFrame:
    """Per-window, per-bucket counts; they are cumulated when read."""
    observed = served.filter(F.col("status") != 422).withWatermark("ts", WATERMARK)
    bucket = bucket_index(F.col("latency_s"), c.HISTOGRAM_BOUNDS).alias("bucket")
    return observed.groupBy(F.window("ts", length).alias("window"), "mode", "status", "chosen", bucket).agg(F.count(F.lit(1)).alias("n"))


def windowed_shadow_mae(served: DataFrame, length: str) -> DataFrame:
    """Count and sum per window, so that windows can be added up further; ``shadow_alert`` gives the mean."""
    compared = served.filter(F.col("shadow_mae").isNotNull()).withWatermark("ts", WATERMARK)
    grouped = compared.groupBy(F.window("ts", length).alias("window"), "mode")
    return grouped.agg(F.count(F.lit(1)).alias("requests"), F.sum("shadow_mae").alias("mae_sum"))


def started(windows: DataFrame) -> DataFrame:
    """Windows with their start as UTC text in place of the pair."""
    return windows.select(window_start(), *[name for name in windows.columns if name != "window"])


def shadow_alert(windows: DataFrame, alert_above: float) -> DataFrame:
    mae = F.col("mae_sum") / F.col("requests")
    return windows.select(*[n for n in windows.columns if n != "mae_sum"], F.round(mae, 6).alias("shadow_mae"), (mae > alert_above).alias("alert"))


def deduplicated(requests: DataFrame, delay: str) -> DataFrame:
    """First arrival of each request id; state is kept for ``delay`` after an id was seen.

    State depends on the id alone: a row that is suppressed never renews it, so a retry after the delay comes through.
    """
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


#: Rows of one client are merged to sessions before the shuffle, so a busy client does not send all its rows to one task.
SESSION_SETTINGS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def sessions(requests: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Closed client sessions; to be run with ``SESSION_SETTINGS``."""
    return (
        requests.withWatermark("ts", WATERMARK)
        .groupBy(F.session_window("ts", gap).alias("session"), "user_id")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("user_id", wall_second(F.col("session.start")).alias("session_start"), wall_second(F.col("session.end")).alias("session_end"), "requests")
    )


def serve_with_refresh(
    requests: DataFrame, path: str, read_aliases: Callable[[], DataFrame], coefficients: DataFrame
) -> DataFrame:
    """Serve a stream with the alias table looked at in every micro-batch.

    A promotion between two batches is served from the next batch on. The table of served models is built and measured only when the
    aliases have changed. Replaying a batch overwrites its own folder, and all folders are read as one partitioned table.
    """
    spark = requests.sparkSession
    log_path = f"{path}/log"
    made: dict = {}

    def serving() -> tuple[DataFrame, int]:
        aliases = read_aliases()
        version = aliases.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(aliases.columns)).cast("decimal(38,0)"))).first()
        if made.get("version") != version:
            stored = f"{path}/serving-{uuid.uuid4().hex}"
            table = routing.serving_models(aliases, coefficients)
            table.write.parquet(stored)
            table = spark.read.schema(table.schema).parquet(stored)
            made.update(version=version, table=table, size=estimated_bytes(table))
        return made["table"], made["size"]

    def serve(batch: DataFrame, batch_id: int) -> None:
        table, size = serving()
        log = serving_log.predict_log(routing.serve(batch, table, serving_bytes=size))
        log.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    # A first folder without rows, so that the log can be read before any request has come.
    no_models = routing.serving_models(spark.createDataFrame([], "model_name string, alias string, version bigint"), coefficients)
    nothing = serving_log.predict_log(routing.serve(spark.createDataFrame([], requests.schema), no_models, serving_bytes=0))
    nothing.write.mode("overwrite").parquet(f"{log_path}/batch=-1")
    job = (
        requests.writeStream.outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(serve)
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    schema = StructType([*nothing.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(log_path).drop("batch")


def alias_state(events: DataFrame, path: str) -> DataFrame:
    """Latest version per (model_name, alias) from a stream of alias events, by (ts, seq).

    One value per key in the state store, kept by the built-in aggregation: a batch costs what its events cost, a late event loses
    against a newer one, and restart and replay are the engine's. Nothing is written but the state, which is read where it lies.
    """
    latest = events.groupBy("model_name", "alias").agg(F.max_by("version", F.struct("ts", "seq")).alias("version"))
    job = (
        latest.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    at = StructType([f for f in events.schema if f.name in ("ts", "seq")])
    held = StructType([*latest.schema.fields, StructField("_at", StructType([at["ts"], at["seq"]]))])
    return state_rows(events.sparkSession, path, held).drop("_at")
