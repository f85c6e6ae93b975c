"""Appended logs, bucket counts, and curves without points on a line."""

import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from relyard.operators import evaluation, serving_log
from relyard.sources import tables


def test_a_repeated_batch_takes_its_own_place(spark, location):
    rows = lambda batch, n, day="2024-01-01": spark.createDataFrame([(day, f"{batch}{i}", i) for i in range(n)], "day string, request_id string, n bigint")
    tables.log_batch(rows("a", 3).union(rows("x", 2, "2024-01-02")), location, "day", "one")
    tables.log_batch(rows("b", 2), location, "day", "two")
    tables.log_batch(rows("c", 4).union(rows("x", 2, "2024-01-02")), location, "day", "one")
    stored = spark.read.parquet(location)
    got = sorted((str(r.day), r.batch, r.request_id) for r in stored.collect())
    first = [("2024-01-01", "one", f"c{i}") for i in range(4)] + [("2024-01-01", "two", f"b{i}") for i in range(2)]
    assert got == first + [("2024-01-02", "one", f"x{i}") for i in range(2)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"
    # A lookup of one day names its folders in the plan.
    plan = stored.where(F.col("day") == "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-01-02" in plan
    assert stored.where(F.col("day") == "2024-01-02").select(F.input_file_name()).distinct().count() == 1


def test_bucket_counts(spark):
    """An even day, a day with one hot bucket, and a request that went where its bucket does not say."""
    start = datetime(2024, 1, 1)
    rows = [(start, "canary", "candidate" if b < 10 else "prod", b, 10) for b in range(100) for _ in range(5)]
    rows += [(start + timedelta(days=1), "canary", "prod", 50, 10)] * 60 + [(start + timedelta(days=1), "canary", "prod", b, 10) for b in range(10, 100)]
    rows += [(start + timedelta(days=1), "canary", "candidate", 77, 10), (start, "prod", "prod", None, None), (start, "canary", None, 3, 10)]
    df = spark.createDataFrame(rows, "ts timestamp, mode string, chosen string, bucket int, canary_pct int")
    got = {(r.day, r.bucket): (r.requests, r.to_candidate, r.as_routed, r.uneven_day) for r in serving_log.canary_buckets(df).collect()}
    assert got["2024-01-01", 3] == (5, 5, True, False) and got["2024-01-01", 10] == (5, 0, True, False)
    assert got["2024-01-02", 50] == (61, 0, True, True) and got["2024-01-02", 77] == (2, 1, False, True)
    assert len(got) == 190


def area(points):
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_corners_keep_the_curve(spark, seed):
    rnd = random.Random(seed)
    rows = [(g, rnd.randint(0, 12) / 12 if g != "flat" else 0.5, rnd.randint(0, 1)) for g in ("a", "b", "flat") for _ in range(80)]
    rows += [("line", s / 40, label) for s in range(40) for label in (0, 1)] + [("a", None, 1), ("b", float("nan"), 0)]
    df = spark.createDataFrame(rows, "slice string, score double, label int")
    corners = evaluation.roc_corners(df, ["slice"]).collect()
    for g in ("a", "b", "flat", "line"):
        own = [(s, y) for n, s, y in rows if n == g and s is not None and s == s]
        n_pos, n_neg = sum(y for _, y in own), sum(1 - y for _, y in own)
        every = [(0, 0)] + [(sum(1 - y for s, y in own if s >= t), sum(y for s, y in own if s >= t)) for t in sorted({s for s, _ in own}, reverse=True)]
        got = sorted(((r.threshold, r.fpr, r.tpr) for r in corners if r.slice == g), reverse=True)
        points = [(0, 0) if t == float("inf") else (sum(1 - y for s, y in own if s >= t), sum(y for s, y in own if s >= t)) for t, *_ in got]
        assert [(round(a / n_neg, 6), round(b / n_pos, 6)) for a, b in points] == [(f, t) for _, f, t in got]
        assert Fraction(area(points)) == Fraction(area(every)) and points[0] == (0, 0) and points[-1] == (n_neg, n_pos)
        for p, q, r in zip(points, points[1:], points[2:]):
            assert p == (0, 0) and q == points[1] or (q[0] - p[0]) * (r[1] - q[1]) != (r[0] - q[0]) * (q[1] - p[1])
    assert sum(r.slice == "line" for r in corners) == 2
