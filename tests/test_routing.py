"""Buckets, seeds, routing matrix, body checks and serving with constant models."""

import hashlib
import json
import random
import string

import pytest
from pyspark.sql import functions as F

from relyard.functions.hashing import bucket_of, canonical_json
from relyard.functions.scoring import MODEL_TYPE
from relyard.operators import routing, serving_log

REQUESTS = "event_id bigint, model_name string, client_request_id string, mode string, endpoint string, body string, latency_s double"
BODY = '{"rows": [{"width": 14, "grain": 20}]}'


def test_bucket_equals_big_integer_remainder(spark):
    rng = random.Random(7)
    seeds = ["", "client-7", "again 3", "é✓"] + ["".join(rng.choices(string.printable, k=rng.randint(1, 60))) for _ in range(500)]
    df = spark.createDataFrame([(s,) for s in seeds], "seed string")
    for row in df.select("seed", bucket_of(F.col("seed")).alias("b")).collect():
        assert row["b"] == int(hashlib.sha256(row["seed"].encode()).hexdigest(), 16) % 100


@pytest.mark.parametrize(
    "pct,bucket,chosen",
    [(0, 0, "prod"), (0, 99, "prod"), (100, 0, "candidate"), (100, 99, "candidate"),
     (10, 0, "candidate"), (10, 9, "candidate"), (10, 10, "prod"), (10, 99, "prod"), (-5, 0, "prod"), (500, 99, "candidate")],
)
def test_canary_matrix(spark, pct, bucket, chosen):
    row = routing.route(spark.createDataFrame([("canary", bucket)], "mode string, bucket int"), pct).first()
    assert (row["chosen"], row["run_shadow"], row["route_error"]) == (chosen, True, None)


def test_fixed_modes_and_errors(spark):
    rows = [("prod", None), ("candidate", None), ("shadow", None), ("bogus", None), (None, None), ("canary", -1), ("canary", 100)]
    got = routing.route(spark.createDataFrame(rows, "mode string, bucket int")).collect()
    assert [(r["chosen"], r["run_shadow"]) for r in got[:3]] == [("prod", False), ("candidate", False), ("prod", True)]
    assert all(r["chosen"] is None and r["route_error"] for r in got[3:])


def test_canonical_json_matches_python(spark):
    rows = [
        [{"y": 2, "x": 1}], [], [{"b": True, "a": None, "c": "t"}], [{"n": {"z": 1, "a": [3, 2]}}], [{"x": -5, "y": 10**15}],
    ]
    floats = [
        [{"x": 1.0, "y": 1e-5}], [{"x": 2.50, "k": 1}], [{"v": 1e22}], [{"é": 3}], [{"size of cell": 14.0, "b": -0.0}], [{"x": 10**25}], [{"x": -0}],
        [{"x": 0.1 + 0.2, "y": 5e-324}],
    ]
    df = spark.createDataFrame([(json.dumps({"rows": r}), json.dumps(r)) for r in rows + floats], "body string, raw string")
    expected = [json.dumps(r, sort_keys=True, separators=(",", ":")) for r in rows + floats]
    exact = [r["t"] for r in df.select(canonical_json(F.col("raw")).alias("t")).collect()]
    assert exact == expected
    native = [r["t"] for r in routing.parse_bodies(df).select(routing.canonical_rows().alias("t")).collect()]
    assert native == expected


def test_body_errors(spark):
    bodies = [BODY, '{"other": []}', '{"rows": {}}', '{"rows": [1]}', "{", None, '{"rows": []}', '{"rows": null}', "[1]"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r["body_error"] for r in routing.parse_bodies(df).collect()]
    assert got == [None, "missing_rows", "rows_not_list", "row_not_object", "invalid_json", "invalid_json", None, "rows_not_list", "missing_rows"]


def test_request_ids(spark):
    df = spark.createDataFrame([(1, " a "), (2, None), (3, "\t "), (2, None)], "event_id bigint, client_request_id string")
    got = routing.assign_request_ids(df).collect()
    assert (got[0]["request_id"], got[0]["client_provided"]) == ("a", True)
    assert not got[1]["client_provided"] and len(got[1]["request_id"]) == 32
    assert got[1]["request_id"] == got[3]["request_id"] != got[2]["request_id"]


def constant_models(spark, prod=0.2, candidate=0.8):
    """Models that answer one value for every row."""
    import math

    def model(p):
        return None if p is None else (math.log(p / (1 - p)), [])

    schema = f"model_name string, prod_version bigint, prod_model {MODEL_TYPE}, candidate_version bigint, candidate_model {MODEL_TYPE}"
    return spark.createDataFrame([("m", 1, model(prod), 2, model(candidate))], schema)


def serve(spark, modes, serving, body=BODY, client="rid"):
    rows = [(i, "m", client, mode, "/predict", body, 0.05) for i, mode in enumerate(modes)]
    return {r["mode"]: r for r in routing.serve(spark.createDataFrame(rows, REQUESTS), serving).collect()}


def test_modes_with_constant_models(spark):
    got = serve(spark, ["prod", "candidate", "shadow", "canary"], constant_models(spark))
    assert [round(got[m]["proba"][0], 9) for m in ("prod", "candidate", "shadow")] == [0.2, 0.8, 0.2]
    assert got["prod"]["shadow_mae"] is None and got["candidate"]["shadow_mae"] is None
    assert round(got["shadow"]["shadow_mae"], 9) == 0.6 and round(got["canary"]["shadow_mae"], 9) == 0.6
    assert got["canary"]["bucket"] is not None and got["canary"]["seed_source"] == "request_id" and got["canary"]["canary_pct"] == 10
    assert got["prod"]["bucket"] is None and got["prod"]["canary_pct"] is None


def test_missing_models(spark):
    got = serve(spark, ["prod", "candidate", "shadow"], constant_models(spark, candidate=None))
    assert got["candidate"]["status"] == 503 and got["candidate"]["proba"] is None
    assert got["shadow"]["status"] == 200 and got["shadow"]["shadow_mae"] is None


def test_bad_requests_and_failures(spark):
    serving = constant_models(spark)
    assert serve(spark, ["prod"], serving, '{"other": []}')["prod"]["status"] == 422
    assert serve(spark, ["bogus"], serving)["bogus"]["status"] == 422
    schema = serving.schema
    needs_feature = spark.createDataFrame([("m", 1, (0.0, [("x", 0.0, 1.0, 1.0)]), None, None)], schema)
    assert serve(spark, ["prod"], needs_feature)["prod"]["status"] == 500
    empty = serve(spark, ["shadow"], serving, '{"rows": []}')["shadow"]
    assert (empty["status"], empty["proba"], empty["shadow_mae"]) == (200, [], 0.0)


def test_standardised_score_with_constant_feature(spark):
    import math

    serving = spark.createDataFrame(
        [("m", 1, (0.5, [("x", 2.0, 4.0, 3.0), ("y", 1.0, 0.0, 2.0)]), None, None)], constant_models(spark).schema
    )
    got = serve(spark, ["prod"], serving, '{"rows": [{"x": 4, "y": 3}]}')["prod"]["proba"][0]
    assert math.isclose(got, 1 / (1 + math.exp(-(0.5 + 3 * 0.5 + 2 * 2.0))))


def test_retries_stick_to_one_bucket(spark):
    rows = [(i, "m", "same-client", "canary", "/predict", BODY, 0.05) for i in range(5)]
    served = routing.serve(spark.createDataFrame(rows, REQUESTS), constant_models(spark))
    row = serving_log.canary_stickiness(served).first()
    assert row["requests"] == 5 and row["sticky"]


def test_log_and_histogram(spark):
    rows = [(i, "m", f"r{i}", "shadow", "/predict", BODY, s) for i, s in enumerate([0.005, 0.0051, 10.0, 11.0])]
    served = routing.serve(spark.createDataFrame(rows, REQUESTS), constant_models(spark))
    log = {r["request_id"]: r for r in serving_log.predict_log(served).collect()}
    assert log["r1"]["latency_ms"] == 5 and log["r3"]["latency_ms"] == 11000 and len(log["r1"]) == 12
    cells = {r["le"]: r["cumulative_count"] for r in serving_log.latency_histogram(served).collect()}
    assert (cells["0.005"], cells["0.01"], cells["7.5"], cells["10.0"], cells["+Inf"]) == (1, 2, 2, 3, 4)


def test_counter_labels(spark):
    rows = [("/predict", "prod", 200), ("/predict", "prod", 200), ("/predict", "x", 422), ("/predict", None, 200), ("/livez", "prod", 200), ("/metrics", "", 200)]
    df = spark.createDataFrame(rows, "endpoint string, mode string, status int")
    got = {(r["endpoint"], r["mode"], r["status"]): r["requests"] for r in serving_log.requests_total(df).collect()}
    assert got == {("/predict", "prod", 200): 2, ("/predict", "invalid", 422): 1, ("/predict", "", 200): 1, ("/livez", "", 200): 1}
