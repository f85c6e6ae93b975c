"""Metrics against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from relyard.operators import evaluation


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        g = "hot" if i % 3 else f"g{i % 4}"
        score = rng.choice([0.0, 0.5, 1.0, rng.random(), rng.random() ** 20, round(rng.random(), 1)])
        rows.append((g, int(rng.random() < 0.3 + 0.4 * score), score))
    rows += [("single", 1, 0.3), ("single", 1, 0.7)]
    return rows, spark.createDataFrame(rows, "g string, label int, score double")


def brute_auc(rows):
    pos, neg = [s for _, y, s in rows if y == 1], [s for _, y, s in rows if y != 1]
    if not pos or not neg:
        return None
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))


def by_group(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


def test_auc(scored):
    rows, df = scored
    got = {r["g"]: r["auc"] for r in evaluation.roc_auc(df, ["g"]).collect()}
    for g, members in by_group(rows).items():
        want = brute_auc(members)
        assert (got[g] is None) if want is None else math.isclose(got[g], want, abs_tol=1e-12)


def test_hard_label_auc_is_balanced_accuracy(scored):
    rows, df = scored
    got = {r["g"]: r["auc"] for r in evaluation.roc_auc(df, ["g"], "label").collect()}
    for g, members in by_group(rows).items():
        pos, neg = [m for m in members if m[1] == 1], [m for m in members if m[1] != 1]
        if pos and neg:
            recall = sum(m[2] >= 0.5 for m in pos) / len(pos)
            specificity = sum(m[2] < 0.5 for m in neg) / len(neg)
            assert math.isclose(got[g], (recall + specificity) / 2, abs_tol=1e-12)


def test_roc_points(scored):
    rows, df = scored
    points = [r for r in evaluation.roc_points(df, ["g"]).collect() if r["g"] == "hot"]
    points.sort(key=lambda r: -r["threshold"])
    assert (points[0]["fpr"], points[0]["tpr"], points[0]["threshold"]) == (0.0, 0.0, float("inf"))
    assert (points[-1]["fpr"], points[-1]["tpr"]) == (1.0, 1.0)
    members = by_group(rows)["hot"]
    pos = sum(y for _, y, _ in members)
    for p in points[1:]:
        assert math.isclose(p["tpr"], sum(y for _, y, s in members if s >= p["threshold"]) / pos, abs_tol=1e-6)


def test_threshold_is_inclusive_and_f1_zero(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.49), ("b", 0, 0.1)], "g string, label int, score double")
    got = {r["g"]: r for r in evaluation.confusion(df, ["g"]).withColumn("f1", evaluation.f1_of()).withColumn("acc", evaluation.accuracy_of()).collect()}
    assert (got["a"]["tp"], got["a"]["tn"], got["a"]["f1"], got["a"]["acc"]) == (1, 1, 1.0, 1.0)
    assert got["b"]["f1"] == 0.0


def test_invalid_rows_void_the_metrics_of_their_group(spark):
    nan = float("nan")
    rows = [("a", 1, 0.9), ("a", 0, None), ("a", None, 0.1), ("b", 1, None), ("c", 1, 0.9), ("c", 0, 0.2), ("d", 1, nan), ("d", 0, 0.1)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    cells = {r["g"]: r for r in evaluation.confusion(df, ["g"]).withColumn("f1", evaluation.f1_of()).withColumn("acc", evaluation.accuracy_of()).collect()}
    assert {g: r["invalid"] for g, r in cells.items()} == {"a": 2, "b": 1, "c": 0, "d": 1}
    assert [(cells[g]["f1"], cells[g]["acc"]) for g in "abcd"] == [(None, None), (None, None), (1.0, 1.0), (None, None)]
    for kind in ("probability", "label"):
        auc = {r["g"]: (r["invalid"], r["auc"]) for r in evaluation.roc_auc(df, ["g"], kind).collect()}
        assert auc == {"a": (2, None), "b": (1, None), "c": (0, 1.0), "d": (1, None)}
        report = {r["g"]: (r["eval_accuracy"], r["eval_roc_auc"], r["gate_ok"]) for r in evaluation.report(df, ["g"], score_kind=kind).collect()}
        assert report == {"a": (None, None, "false"), "b": (None, None, "false"), "c": (1.0, 1.0, "true"), "d": (None, None, "false")}


def test_gate(spark):
    df = spark.createDataFrame([(0.95,), (0.9499,), (float("nan"),), (None,)], "auc double")
    assert [r["g"] for r in df.select(evaluation.gate_text(F.col("auc")).alias("g")).collect()] == ["true", "false", "false", "false"]


def test_score_range(spark):
    df = spark.createDataFrame([([1, 2], [0.0, 1.0]), ([1], [1.1]), ([1, 2], [0.5]), ([1], [float("nan")])], "rows array<int>, proba array<double>")
    got = [(r["in_range"], r["one_per_row"]) for r in evaluation.score_range(df, "rows", "proba").collect()]
    assert got == [(True, True), (False, True), (True, False), (False, True)]
