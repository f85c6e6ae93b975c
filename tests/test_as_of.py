"""Alias lookup by event time on streams against plain Python and the batch operator."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from relyard.operators import registry
from relyard.streaming import as_of, jobs

START = datetime(2024, 1, 1)
REQUESTS = "request_id bigint, model_name string, alias string, ts timestamp"
EVENTS = "model_name string, alias string, version bigint, ts timestamp, seq bigint"


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def arrive(spark, location, name, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{location}/{name}")


def run(spark, location, salts=1):
    streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{location}/{n}") for n, s in (("requests", REQUESTS), ("events", EVENTS))]
    rows = as_of.answer_to(*streams, location, "10 minutes", salts).collect()
    assert len({r.request_id for r in rows}) == len(rows)
    return {r.request_id: r.version for r in rows}


def beat(spark, location, minutes):
    arrive(spark, location, "requests", REQUESTS, [(None, None, None, at(minutes))])
    arrive(spark, location, "events", EVENTS, [(None, None, None, at(minutes), None)])


def brute(events, requests):
    out = {}
    for request_id, model, alias, ts in requests:
        if model is not None and ts is not None:
            known = [(e[3], e[4], e[2]) for e in events if e[:2] == (model, alias) and e[3] <= ts]
            out[request_id] = max(known)[2] if known else None
    return out


def test_promotion_splits_the_requests_of_one_batch(spark, location):
    """Rows of one batch, out of order; equal instants go by seq, and an event at the instant of a request counts."""
    events = [("m", "prod", 1, at(0), 1), ("m", "prod", 3, at(20), 7), ("m", "prod", 2, at(20), 6), ("n", "prod", 9, at(5), 1)]
    requests = [(1, "m", "prod", at(25)), (2, "m", "prod", at(19)), (3, "m", "prod", at(20)), (4, "m", "canary", at(25)), (5, "n", "prod", at(4)), (6, None, "prod", at(4)), (7, "m", "prod", None)]
    arrive(spark, location, "events", EVENTS, events)
    arrive(spark, location, "requests", REQUESTS, requests)
    assert run(spark, location).keys() <= {2, 5}  # later ones wait for the watermark
    beat(spark, location, 100)
    assert run(spark, location) == {1: 3, 2: 1, 3: 3, 4: None, 5: None}


def test_requests_wait_for_the_slower_stream_and_survive_a_restart(spark, location):
    arrive(spark, location, "requests", REQUESTS, [(1, "m", "prod", at(30)), (None, None, None, at(200))])
    arrive(spark, location, "events", EVENTS, [("m", "prod", 1, at(0), 1)])
    assert run(spark, location) == {}
    arrive(spark, location, "events", EVENTS, [("m", "prod", 2, at(29), 2), ("m", "prod", 3, at(31), 3)])
    assert run(spark, location) == {}
    beat(spark, location, 300)
    assert run(spark, location) == {1: 2}
    arrive(spark, location, "requests", REQUESTS, [(2, "m", "prod", at(310)), (3, "m", "prod", at(1))])  # the last one is late
    beat(spark, location, 500)
    assert run(spark, location) == run(spark, location) == {1: 2, 2: 3}


def test_equals_the_batch_operator(spark, location):
    """A hot model over several salts, in files of any order."""
    rnd = random.Random(4)
    models = ["hot"] * 6 + ["a", "b"]
    events = [(rnd.choice(models), rnd.choice(["prod", "candidate"]), v, at(rnd.randint(0, 9)), v) for v in range(60)]
    requests = [(i, rnd.choice(models), rnd.choice(["prod", "candidate"]), at(rnd.randint(0, 9))) for i in range(300)]
    for part in range(2):
        arrive(spark, location, "events", EVENTS, events[part::2])
        arrive(spark, location, "requests", REQUESTS, requests[part::2])
    beat(spark, location, 1000)
    got = run(spark, location, salts=3)
    assert got == brute(events, requests)
    batch = registry.alias_as_of(spark.createDataFrame(events, EVENTS), spark.createDataFrame(requests, REQUESTS).select("model_name", "alias", "ts", "request_id"))
    assert got == {r.request_id: r.as_of_version for r in batch.collect()}


times = st.integers(0, 12)


@given(st.lists(st.tuples(times, st.integers(0, 3), st.integers(1, 99)), max_size=12), st.lists(st.tuples(times, st.integers(0, 99)), max_size=12), st.lists(times, min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_answers_in_steps_equal_answers_at_once(events, requests, steps):
    want = {(r, ts): max((e for e in events if e[0] <= ts), default=(None,) * 3)[2] for ts, r in requests}
    base, got = None, {}
    left_events, left = events, requests
    for upto in [*sorted(steps), 99]:
        base, out, left_events, left = as_of.answer(base, left_events, left, upto)
        got |= {(r, ts): v for r, ts, v in out}
    assert got == want and not left and not left_events


def test_many_models_share_few_state_keys(spark, location):
    """Rows of thousands of models wait in a few buckets; a row is late also where its model had none before, and a null version is an answer."""
    rnd = random.Random(8)
    events = [(f"m{rnd.randint(0, 2000)}", rnd.choice(["prod", "candidate", None]), rnd.choice([None, v]), at(rnd.randint(0, 9)), v) for v in range(3000)]
    requests = [(i, f"m{rnd.randint(0, 2000)}", rnd.choice(["prod", "candidate", None]), at(rnd.randint(0, 9))) for i in range(6000)]

    def answers():
        streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{location}/{n}") for n, s in (("requests", REQUESTS), ("events", EVENTS))]
        return as_of.answer_to(*streams, location, "10 minutes", 2, buckets=8).collect()

    arrive(spark, location, "events", EVENTS, events)
    arrive(spark, location, "requests", REQUESTS, requests)
    beat(spark, location, 100)
    assert {r.request_id: r.version for r in answers()} == brute(events, requests)
    held = {}
    with jobs.settings(spark, as_of.STATE_SETTINGS):
        for name in ("passed", "requests"):
            held[name] = spark.read.format("statestore").option("path", f"{location}/checkpoint").option("stateVarName", name).load().count()
    assert held == {"passed": 8, "requests": 0}
    arrive(spark, location, "requests", REQUESTS, [(6000, "new", "prod", at(5)), (6001, "new", "prod", at(95)), (6002, "m1", None, at(90))])
    arrive(spark, location, "events", EVENTS, [("new", "prod", 7, at(91), 1), ("new", "prod", 8, at(89), 2)])  # the later one is late
    beat(spark, location, 1000)
    got = {r.request_id: r.version for r in answers()}
    assert got == brute([*events, ("new", "prod", 7, at(91), 1)], [*requests, (6001, "new", "prod", at(95))])


def test_nulls_among_equal_instants_come_first():
    known = pa.table([["m"] * 4, [None] * 4, [5, 5, 5, 9], [None, 1, 1, 2], [7, None, 3, 1]], as_of.ROWS[as_of.EVENT])
    asked = pa.table([["m", "m", "n", "m", "m"], [None, None, None, "prod", None], [4, 5, 6, 6, 10], [1, 2, 3, 4, None]], as_of.ROWS[as_of.REQUEST])
    versions, newest = as_of.resolved(known, asked)
    assert versions.to_pylist() == [None, 3, None, None, 1]
    assert newest.to_pylist() == [{"model_name": "m", "alias": None, "at": 9, "seq": 2, "version": 1}]
