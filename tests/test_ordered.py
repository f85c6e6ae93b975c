"""Binned operators against pandas, with one group holding most of the rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from relyard.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(900):
        group = "hot" if rng.random() < 0.6 else f"g{rng.randint(0, 30)}"
        t = rng.randint(0, 400)
        data.append((group, t, i, rng.randint(-5, 5), rng.choice([None, None, i])))
    pdf = pd.DataFrame(data, columns=["g", "t", "i", "x", "maybe"])
    df = spark.createDataFrame(data, "g string, t int, i int, x bigint, maybe bigint")
    binned = df.withColumn("b1", F.floor(F.col("t") / 100)).withColumn("b2", F.floor(F.col("t") / 10))
    return pdf.sort_values(["g", "t", "i"]).reset_index(drop=True), binned


@pytest.mark.parametrize("bins", [[], ["b1"], ["b1", "b2"]])
def test_rank_and_sums(rows, bins):
    pdf, df = rows
    ranked = ordered.exact_rank(df, ["g"], bins, ["t", "i"])
    got = {r["i"]: r["rank"] for r in ranked.collect()}
    assert got == dict(zip(pdf.i, pdf.groupby("g").cumcount() + 1))
    summed = ordered.running_sums(df, ["g"], bins, ["t", "i"], {"s": F.col("x")})
    assert {r["i"]: r["s"] for r in summed.collect()} == dict(zip(pdf.i, pdf.groupby("g").x.cumsum() - pdf.x))


@pytest.mark.parametrize("bins", [["b1"], ["b1", "b2"]])
def test_global_rank(rows, bins):
    pdf, df = rows
    got = {r["i"]: r["rank"] for r in ordered.exact_rank(df, [], bins, ["t", "i"]).collect()}
    assert got == {i: n + 1 for n, i in enumerate(pdf.sort_values(["t", "i"]).i)}


@pytest.mark.parametrize("bins", [[], ["b1"], ["b1", "b2"]])
def test_previous_values(rows, bins):
    pdf, df = rows
    lagged = ordered.previous_values(df, ["g"], bins, ["t", "i"], {"pi": "i", "px": "x"})
    got = {r["i"]: (r["pi"], r["px"]) for r in lagged.collect()}
    want = pdf.groupby("g")[["i", "x"]].shift(1)
    assert got == {i: (None, None) if pd.isna(a) else (int(a), int(b)) for i, a, b in zip(pdf.i, want.i, want.x)}


@pytest.mark.parametrize("bins", [[], ["b1"], ["b1", "b2"]])
@pytest.mark.parametrize("strict", [False, True])
def test_latest_before(rows, bins, strict):
    pdf, df = rows
    carried = ordered.latest_before(df, ["g"], bins, ["t", "i"], "maybe", "last", strict)
    filled = pdf.groupby("g").maybe.ffill()
    if strict:
        filled = filled.groupby(pdf.g).shift(1)
    got = {r["i"]: r["last"] for r in carried.collect()}
    assert got == {i: None if pd.isna(v) else int(v) for i, v in zip(pdf.i, filled)}


def test_bins_only_where_a_group_is_large(rows):
    pdf, df = rows
    largest = int(pdf.groupby("g").size().max())
    assert ordered.largest_group(df, ["g"]) == largest
    assert ordered.needed_bins(df, ["g"], ["b1"], max_rows=largest) == []
    assert ordered.needed_bins(df, ["g"], ["b1"], max_rows=largest - 1) == ["b1"]
    assert ordered.needed_bins(df, [], ["b1"], max_rows=10**9) == ["b1"]


def test_score_band_never_decreases(spark):
    rng = random.Random(5)
    values = sorted({0.0, 1.0, 5e-324, 1e-300, 0.5, 1 - 1e-16} | {rng.random() for _ in range(500)} | {rng.random() ** 40 for _ in range(500)})
    df = spark.createDataFrame([(v,) for v in values], "p double")
    bands = [r["b"] for r in df.select("p", ordered.score_band(F.col("p")).alias("b")).orderBy("p").collect()]
    assert None not in bands and bands == sorted(bands) and len(set(bands)) > 100


@pytest.mark.parametrize("limit", [None, 1])
@pytest.mark.parametrize("per_salt", [10, 10**6])
def test_lookup_join_keeps_every_row(spark, limit, per_salt):
    facts = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    lookup = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    got = ordered.lookup_join(facts, lookup, ["k"], ["id"], max_broadcast_bytes=limit, rows_per_salt=per_salt)
    want = facts.join(lookup, "k", "left")
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, want.select("id", "k", "v").collect()))


def test_estimated_bytes_follow_the_width_of_rows(spark):
    thin, wide = (spark.range(100).select("id", F.repeat(F.lit("x"), n).alias("s")) for n in (1, 1000))
    assert ordered.estimated_bytes(wide) > 100 * 1000 > ordered.estimated_bytes(thin)
    assert ordered.estimated_bytes(thin.limit(0)) == 0
