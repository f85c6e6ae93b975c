"""States that add up: ordered hashes and quantile sketches, in parts and as a whole."""

import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from relyard.functions.hashing import row_text, sha256_text
from relyard.operators import sequence_hash as sh, sketches

SCHEMA = "day timestamp_ntz, k bigint, v string"
START = datetime(2024, 1, 1)


def rows_of(n, seed=3):
    rnd = random.Random(seed)
    rows = [(START + timedelta(days=rnd.randint(0, 60)), rnd.choice([None, *range(9)]), rnd.choice(["x", "y", "", None, "z" * 50])) for _ in range(n)]
    return rows + [(START + timedelta(days=70), 5, "hot")] * n


def brute(spark, rows):
    """Horner over the digests in the order of (day, k, digest)."""
    df = spark.createDataFrame(rows, SCHEMA)
    digests = df.select("day", "k", sha256_text(row_text(df)).alias("h")).collect()
    ordered = sorted(digests, key=lambda r: (r.day, r.k is not None, r.k or 0, r.h))
    state = [0, 0]
    for r in ordered:
        for i, point in enumerate(sh.POINTS):
            state[i] = (state[i] * point + int(r.h[i * 15 : i * 15 + 15], 16)) % sh.PRIME
    return hashlib.sha256(f"{len(ordered)}|{state[0]}|{state[1]}".encode()).hexdigest()


def folded(states):
    rows = sh.fold_states(states).collect()
    return (rows[0].content_hash, rows[0].row_count, rows[0].in_order) if rows else None


def states(df, stretch=True):
    return sh.sequence_states(df, ["day", "k"], F.date_format("day", "yyyy-MM") if stretch else None)


@given(st.lists(st.tuples(st.integers(0, sh.PRIME - 1), st.integers(0, sh.PRIME - 1)), min_size=1, max_size=20))
@settings(max_examples=300, deadline=None)
def test_products_stay_exact(pairs):
    a, b = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    assert sh._times(a, b).tolist() == [x * y % sh.PRIME for x, y in pairs]


@pytest.mark.parametrize("n", [1, 300, 6000])
def test_whole_equals_combined_parts(spark, n):
    rows = rows_of(n)
    want = brute(spark, rows), len(rows), True
    df = spark.createDataFrame(rows, SCHEMA)
    assert folded(states(df)) == folded(states(df, False)) == folded(states(df.repartition(13))) == folded(states(df.orderBy(F.desc("v")))) == want
    cut = START + timedelta(days=40)
    early, late = states(df.where(F.col("day") < cut)), states(df.where(F.col("day") >= cut))
    assert folded(early.unionByName(late)) == folded(late.unionByName(early)) == want


def test_order_and_rows_change_the_hash(spark):
    rows = [(START + timedelta(days=i), i, "abc"[i % 3]) for i in range(9)]
    swapped = [*rows[:3], (rows[3][0], 3, rows[4][2]), (rows[4][0], 4, rows[3][2]), *rows[5:]]
    hashes = {folded(states(spark.createDataFrame(r, SCHEMA)))[0] for r in (rows, swapped, rows[1:], rows + rows[-1:])}
    assert len(hashes) == 4


def test_overlapping_stretches_void_the_hash_until_hashed_anew(spark):
    rows = rows_of(200)
    df = spark.createDataFrame(rows, SCHEMA)
    late_arrivals = spark.createDataFrame([(START + timedelta(days=3), 1, "late")], SCHEMA)
    mixed = states(df).unionByName(states(late_arrivals))
    assert folded(mixed) == (None, len(rows) + 1, False)
    january = df.where(F.month("day") == 1).unionByName(late_arrivals)
    assert folded(sh.replace_states(mixed, states(january))) == (brute(spark, rows + [(START + timedelta(days=3), 1, "late")]), len(rows) + 1, True)


def test_groups_empty_tables_and_unknown_columns(spark):
    df = spark.createDataFrame(rows_of(50), SCHEMA)
    monthly = {r.stretch: r.content_hash for r in sh.fold_states(states(df), ["stretch"]).collect()}
    for month, got in monthly.items():
        assert got == folded(states(df.where(F.date_format("day", "yyyy-MM") == month)))[0]
    assert states(df.limit(0)).collect() == []
    no_stretch = sh.sequence_states(df, ["day"], F.lit(None))
    assert {r.stretch for r in no_stretch.collect()} == {"~"}
    with pytest.raises(ValueError, match="nope"):
        sh.sequence_states(df, ["nope"])


@given(st.integers(0, 2**48 - 1))
@settings(max_examples=8, deadline=None)
def test_powers(spark, exponent):
    got = spark.range(1).select(*[sh._power(p, F.lit(exponent)).alias(f"p{i}") for i, p in enumerate(sh.POINTS)]).first()
    assert [int(x) for x in got] == [pow(p, exponent, sh.PRIME) for p in sh.POINTS]


def test_sketches_of_days_merge_to_months(spark):
    rnd = random.Random(1)
    rows = [(day, rnd.choice("ab"), rnd.choice([rnd.gauss(0, 1), float(rnd.randint(0, 3))])) for day in range(40) for _ in range(500)]
    rows += [(0, "c", None), (1, "c", float("nan")), (0, "a", None)]
    df = spark.createDataFrame(rows, "day int, mode string, x double")
    daily = sketches.quantile_states(df, "x", ["day", "mode"])
    merged = sketches.merge_quantile_states(daily, ["mode"])
    got = {r["mode"]: r for r in merged.collect()}
    assert (got["c"].row_count, got["c"].n, got["c"].low) == (2, 0, None)
    for mode in "ab":
        values = sorted(x for _, m, x in rows if m == mode and x is not None)
        assert (got[mode].n, got[mode].low, got[mode].high) == (len(values), values[0], values[-1])
    estimates = sketches.quantiles(merged, [0, 0.1, 0.5, 0.99, 1])
    for r in estimates.collect():
        if r["mode"] == "c":
            assert r.value is None
            continue
        values = [x for _, m, x in rows if m == r["mode"] and x is not None]
        below, upto = (np.mean([f(x) for x in values]) for f in (lambda x: x < r.value, lambda x: x <= r.value))
        assert below - 3 * sketches.rank_error() <= r.q <= upto + 3 * sketches.rank_error()
    checked = sketches.within_rank_error(estimates, df, "x", ["mode"], 3 * sketches.rank_error())
    assert all(r.within for r in checked.collect())
    wrong = estimates.withColumn("value", F.col("value") + 1)
    assert not all(r.within for r in sketches.within_rank_error(wrong, df, "x", ["mode"], 3 * sketches.rank_error()).collect())
