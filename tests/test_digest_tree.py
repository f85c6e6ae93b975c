"""Digest trees of dataset versions against a comparison of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from relyard.functions.hashing import row_text, sha256_text
from relyard.operators import digest_tree

SCHEMA = "k bigint, v string, version string"


def versions_of(n):
    rnd = random.Random(n)
    first = {k: f"v{k % 7}" for k in range(n)}
    second = dict(first)
    for k in rnd.sample(range(n), max(1, n // 100)):
        second[k] = "changed"
    third = {k: v for k, v in second.items() if k % 251 != 3} | {n + k: None for k in range(3)}
    return {"1": first, "2": second, "3": third, "4": third}


def brute(spark, versions, pairs):
    keys = sorted({k for v in versions.values() for k in v})
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    prefix = {r.k: r.h[:4] for r in df.select("k", sha256_text(row_text(df)).alias("h")).collect()}
    out = set()
    for old, new in pairs:
        cells = lambda v: {p: {k: x for k, x in versions[v].items() if prefix[k] == p} for p in {prefix[k] for k in versions[v]}}
        a, b = cells(old), cells(new)
        out |= {(old, new, p, len(a.get(p, {})), len(b.get(p, {}))) for p in a.keys() | b.keys() if a.get(p) != b.get(p)}
    return out


@pytest.mark.parametrize("n", [3, 900])
def test_differing_leaves(spark, location, n):
    versions = versions_of(n)
    pairs = [("1", "2"), ("2", "3"), ("3", "4"), ("1", "3"), ("4", "1")]
    for v, rows in versions.items():  # versions are appended one by one
        df = spark.createDataFrame([(k, x, v) for k, x in rows.items()], SCHEMA).repartition(3)
        digest_tree.write_tree(digest_tree.tree_nodes(df, ["k"], "version"), location)
    tree = digest_tree.read_tree(spark, location)
    got = digest_tree.differing_leaves(tree, spark.createDataFrame(pairs, "previous_version string, version string"))
    assert {tuple(r) for r in got.collect()} == brute(spark, versions, pairs)


def test_only_differing_branches_are_read(spark, location):
    rows = [(k, "x", v) for v in "12" for k in range(2000)]
    rows[0] = (0, "y", "1")
    digest_tree.write_tree(digest_tree.tree_nodes(spark.createDataFrame(rows, SCHEMA), ["k"], "version"), location)
    tree = digest_tree.read_tree(spark, location)
    branch = spark.createDataFrame([(0,)], "k bigint")
    name = branch.select(F.concat(F.lit("p"), F.substring(sha256_text(row_text(branch)), 1, 2)).alias("branch"))
    below = digest_tree.branch_nodes(tree, 2, name)
    # Other folders are pruned before the scan.
    plan = below._jdf.queryExecution().executedPlan().toString() if hasattr(below, "_jdf") else ""
    assert "PartitionFilters" in plan and below.select("branch").distinct().count() == 1
    assert digest_tree.differing_leaves(tree, spark.createDataFrame([("1", "2")], "previous_version string, version string")).count() == 1


def test_flags(spark):
    rows = [("d", 1, "s", "c", 5, "x"), ("d", 2, "s", "c", 5, None), ("d", 4, "t", "e", 6, None), ("e", 1, "s", "c", 5, "x"), ("e", 2, "s", "c", 5, "x")]
    table = spark.createDataFrame(rows, "dataset string, v int, schema_hash string, content_hash string, row_count bigint, config_hash string")
    got = {(r.dataset, r.previous_v, r.v): r.changed for r in digest_tree.version_drift(table, ["dataset"], "v").collect()}
    assert got == {("d", 1, 2): "config", ("d", 2, 4): "schema,content,rows", ("e", 1, 2): ""}
