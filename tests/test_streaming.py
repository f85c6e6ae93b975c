"""Streams against batch: restart, retries, alias change between batches, late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relyard.operators import routing
from relyard.streaming import jobs
from tests.test_routing import BODY

START = datetime(2024, 1, 1)


def arrive(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_retries_in_later_files_are_dropped(spark, location):
    schema, folder = "request_id string, ts timestamp", f"{location}/in"
    stream = lambda: jobs.deduplicated(source(spark, schema, folder), "1 day")
    arrive(spark, [("a", START), ("b", START), ("a", START)], schema, folder)
    assert jobs.append_to(stream(), location).count() == 2
    arrive(spark, [("a", START + timedelta(hours=1)), ("c", START)], schema, folder)
    got = jobs.append_to(stream(), location).select("request_id").collect()
    assert sorted(r[0] for r in got) == ["a", "b", "c"]


def test_alias_state_keeps_the_last_event(spark, location):
    schema, folder = "model_name string, alias string, version bigint, ts timestamp, seq bigint", f"{location}/in"
    arrive(spark, [("m", "prod", 1, START, 1), ("m", "prod", 2, START, 2), ("n", "prod", 1, START, 1)], schema, folder)
    state = {(r["model_name"], r["alias"]): r["version"] for r in jobs.alias_state(source(spark, schema, folder), location).collect()}
    assert state == {("m", "prod"): 2, ("n", "prod"): 1}
    arrive(spark, [("m", "prod", 9, START - timedelta(days=1), 9), ("n", "prod", 5, START + timedelta(days=1), 0)], schema, folder)
    for _ in range(2):  # the second run finds nothing new
        state = {(r["model_name"], r["alias"]): r["version"] for r in jobs.alias_state(source(spark, schema, folder), location).collect()}
        assert state == {("m", "prod"): 2, ("n", "prod"): 5}
    for day in range(2, 6):
        arrive(spark, [("m", "prod", 10 + day, START + timedelta(days=day), 1)], schema, folder)
    assert jobs.alias_state(source(spark, schema, folder), location).count() == 2



def test_promotion_is_served_from_the_next_batch(spark, location):
    schema = "event_id bigint, ts timestamp, model_name string, client_request_id string, mode string, endpoint string, body string, latency_s double"
    folder = f"{location}/in"
    for i in range(2):
        arrive(spark, [(i, START, "m", f"r{i}", "prod", "/predict", BODY, 0.1)], schema, folder)
    coefficients = spark.createDataFrame(
        [("m", 1, (0.0, [])), ("m", 2, (0.0, []))],
        "model_name string, version bigint, model struct<intercept: double, terms: array<struct<feature: string, mean: double, std: double, coef: double>>>",
    )
    served_with = iter([1, 2])

    def read_aliases():
        return spark.createDataFrame([("m", "prod", next(served_with))], "model_name string, alias string, version bigint")

    log = jobs.serve_with_refresh(source(spark, schema, folder), location, read_aliases, coefficients)
    assert sorted(r["prod_version"] for r in log.collect()) == [1, 2]
    idle = jobs.serve_with_refresh(source(spark, schema, folder), location, read_aliases, coefficients)
    assert sorted(r["prod_version"] for r in idle.collect()) == [1, 2]


def test_sessions_merge_across_the_gap(spark, location):
    schema, folder = "user_id bigint, ts timestamp", f"{location}/in"
    minutes = [0, 10, 35, 80]
    rows = [(1, START + timedelta(minutes=m)) for m in minutes] + [(2, START + timedelta(days=3))]
    arrive(spark, rows, schema, folder)
    got = jobs.append_to(jobs.sessions(source(spark, schema, folder)), location, jobs.SESSION_SETTINGS).orderBy("session_start").collect()
    assert [(r["user_id"], r["requests"]) for r in got] == [(1, 3), (1, 1)]


@pytest.mark.parametrize("length,slide", [("1 hour", None), ("2 hours", "1 hour")])
def test_windowed_counts_equal_batch(spark, location, length, slide):
    schema = "ts timestamp, endpoint string, mode string, status int"
    folder = f"{location}/in"
    rows = [(START + timedelta(minutes=7 * i), "/predict", "prod" if i % 3 else "odd", 200) for i in range(60)]
    arrive(spark, rows[:30], schema, folder)
    arrive(spark, rows[30:], schema, folder)
    run = lambda: jobs.started(jobs.windows_to(jobs.windowed_requests(source(spark, schema, folder), length, slide), location))
    streamed = run()
    batch = jobs.started(jobs.windowed_requests(spark.read.schema(schema).parquet(folder), length, slide))
    assert streamed.columns == batch.columns
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect())) == sorted(map(tuple, run().collect()))


def test_closed_windows_are_written_once_and_open_ones_not_at_all(spark, location):
    """Twelve batches into one open window write no row; what is written later is what closes."""
    schema, folder = "ts timestamp, endpoint string, mode string, status int", f"{location}/in"
    row = lambda day, m: (START + timedelta(days=day, minutes=m), "/predict", "prod", 200)
    run = lambda: jobs.windows_to(jobs.windowed_requests(source(spark, schema, folder), "1 day"), location)
    for m in range(12):
        arrive(spark, [row(0, m)], schema, folder)
    assert [r.requests for r in run().collect()] == [12]
    assert spark.read.parquet(f"{location}/rows").count() == 0
    arrive(spark, [row(3, 0)], schema, folder)
    assert sorted(r.requests for r in run().collect()) == [1, 12] == sorted(r.requests for r in run().collect())
    assert spark.read.parquet(f"{location}/rows").count() == 1


def test_windows_of_sums(spark, location):
    schema, folder = "ts timestamp, mode string, shadow_mae double", f"{location}/in"
    rows = [(START + timedelta(hours=h), "canary", x) for h, x in enumerate([0.5, 0.25, None, 0.75])] + [(START + timedelta(days=2), "shadow", 0.125)]
    arrive(spark, rows, schema, folder)
    windows = jobs.windows_to(jobs.windowed_shadow_mae(source(spark, schema, folder), "1 day"), location)
    got = {tuple(r) for r in jobs.shadow_alert(jobs.started(windows), 0.3).collect()}
    assert got == {("2024-01-01 00:00", "canary", 3, 0.5, True), ("2024-01-03 00:00", "shadow", 1, 0.125, False)}


def test_empty_streams_and_other_time_zones(spark, location):
    """Nothing has come yet; and jobs leave the session's settings as they are and don't depend on its zone."""
    schema, folder = "ts timestamp_ntz, endpoint string, mode string, status int", f"{location}/in"
    spark.createDataFrame([], schema).write.parquet(folder)
    run = lambda: jobs.started(
        jobs.windows_to(jobs.windowed_requests(source(spark, schema, folder).withColumn("ts", jobs.event_time(F.col("ts"))), "1 hour"), location)
    )
    assert run().collect() == []
    arrive(spark, [(datetime(2024, 3, 10, 2, 30), "/predict", "prod", 200), (datetime(2024, 3, 12), "/predict", "prod", 200)], schema, folder)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        before = dict(spark.conf.getAll)
        assert {(r.window_start, r.requests) for r in run().collect()} == {("2024-03-10 02:00", 1), ("2024-03-12 00:00", 1)}
        clock = spark.sql("SELECT TIMESTAMP '1969-12-31 23:59:58Z' AS t").select(jobs.wall_second(F.col("t")), jobs.wall_minute(F.col("t"))).first()
        assert tuple(clock) == ("1969-12-31 23:59:58", "1969-12-31 23:59")
        jobs.append_to(jobs.sessions(source(spark, schema, folder).select(F.lit(1).alias("user_id"), jobs.event_time(F.col("ts")).alias("ts"))), f"{location}/s", jobs.SESSION_SETTINGS)
        assert dict(spark.conf.getAll) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_window_state_shrinks_behind_the_watermark(spark, location):
    schema, folder = "ts timestamp, endpoint string, mode string, status int", f"{location}/in"
    for day in range(6):
        arrive(spark, [(START + timedelta(days=day, minutes=m), "/predict", "prod", 200) for m in range(0, 600, 60)], schema, folder)
    counts = jobs.windowed_requests(source(spark, schema, folder), "1 hour")
    held = []
    job = counts.writeStream.outputMode("update").option("checkpointLocation", f"{location}/c").format("noop").trigger(availableNow=True).start()
    job.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress if p["stateOperators"]]
    assert max(held) <= 20 and len(held) >= 6


def test_retry_after_the_delay_comes_through(spark, location):
    """A suppressed retry in between does not renew the state of an id."""
    schema, folder = "request_id string, ts timestamp", f"{location}/in"
    for minutes in (0, 40, 61, 89):
        name = "x" if minutes != 61 else "other"
        arrive(spark, [(name, START + timedelta(minutes=minutes))], schema, folder)
        if name == "other":
            # The first moves the watermark past the delay, the second lets the state go.
            arrive(spark, [("later", START + timedelta(minutes=125))], schema, folder)
            arrive(spark, [("later", START + timedelta(minutes=126))], schema, folder)
    got = [r["request_id"] for r in jobs.append_to(jobs.deduplicated(source(spark, schema, folder), "1 hour"), location).collect()]
    assert got.count("x") == 2 and sorted(set(got)) == ["later", "other", "x"]


def test_stable_ids_make_a_replay_equal(spark):
    df = spark.range(20).select(F.col("id").alias("event_id"), F.lit(None).cast("string").alias("client_request_id"))
    ids = lambda x: sorted(r["request_id"] for r in routing.assign_request_ids(x).collect())
    assert ids(df) == ids(df.repartition(3))
