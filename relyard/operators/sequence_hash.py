"""Ordered content hash that adds up.

Rows in key order are read as the coefficients of two polynomials modulo the prime 2^61 - 1, one at each of two fixed points:

    state(d0 .. dn-1) = (n, sum of di * B^(n-1-i))        combine(a, b) = (na + nb, ha * B^nb + hb)

Combining is associative, so a dataset keeps one state per stretch of its key (a day, a month, an id range) and a new stretch is hashed
alone: nothing old is read, ranked or sorted again. ``sequence_states`` makes states, ``fold_states`` combines them to the hash of a
whole. States hold the first and the last key, so a fold sees whether they follow one another; where they overlap the hash is null, and
``replace_states`` puts in the states of the stretches that were hashed anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from relyard.functions.hashing import row_text, sha256_text
from relyard.session import new_location

PRIME = 2**61 - 1
#: The two points, fixed: stored states depend on them.
POINTS = (1_000_000_000_000_000_003, 1_234_567_890_123_456_789)
DIGITS = 15
_BLOCK = 4096
_WIDE = "decimal(38,0)"


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below it, by 31-bit halves so that nothing leaves 64 bits."""
    low = np.uint64(2**31 - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = a1 * b0 + a0 * b1
    prime = np.uint64(PRIME)
    high = (a1 * b1 * np.uint64(2) + (middle >> np.uint64(30))) % prime
    rest = (((middle & np.uint64(2**30 - 1)) << np.uint64(31)) + (a0 * b0) % prime) % prime
    return (high + rest) % prime


def _powers(point: int) -> np.ndarray:
    out, power = [], 1
    for _ in range(_BLOCK):
        out.append(power)
        power = power * point % PRIME
    return np.array(out[::-1], np.uint64)


def _extend(state: int, digests: np.ndarray, point: int, powers: np.ndarray) -> int:
    """State after more digests, a block at a time."""
    for at in range(0, len(digests), _BLOCK):
        part = digests[at : at + _BLOCK]
        terms = _times(part, powers[-len(part) :])
        total = (int((terms >> np.uint64(32)).sum()) << 32) + int((terms & np.uint64(2**32 - 1)).sum())
        state = (state * pow(point, len(part), PRIME) + total) % PRIME
    return state


def _states(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (stretch, key columns, d0, d1) to one state per stretch of the partition."""
    powers = [_powers(p) for p in POINTS]
    rows: list[list] = []  # stretch, first key, last key, n, h0, h1
    for batch in batches:
        stretch = batch.column(0).to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(stretch[1:] != stretch[:-1]) + 1).tolist(), batch.num_rows]
        key = pa.RecordBatch.from_arrays(batch.columns[1 : keys + 3], batch.schema.names[1 : keys + 3])
        digests = [batch.column(keys + 1 + k).to_numpy().astype(np.uint64) for k in (0, 1)]
        start = 0
        for end in ends:
            if end == start:
                continue
            if not rows or rows[-1][0] != stretch[start]:
                rows.append([stretch[start], key.slice(start, 1), None, 0, 0, 0])
            now = rows[-1]
            now[2], now[3] = key.slice(end - 1, 1), now[3] + end - start
            for k, point in enumerate(POINTS):
                now[4 + k] = _extend(now[4 + k], digests[k][start:end], point, powers[k])
            start = end
    if rows:
        ends_of = [pa.concat_arrays([r[k].to_struct_array() for r in rows]) for k in (1, 2)]
        numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *ends_of, *numbers], ["stretch", "first", "last", "row_count", "h0", "h1"])


def sequence_states(df: DataFrame, order: Sequence[str], stretch: Column | None = None) -> DataFrame:
    """(stretch, first, last, row_count, h0, h1) of the rows of ``df`` in the order of the ``order`` columns.

    Rows that share a key follow their digests. ``stretch`` names the part of the key's range that a row belongs to; it must not
    return once the key has passed on (null is a part of its own). Only keys and two numbers per row are stored once and shuffled by
    ranges, so the table is read once and no task gets more than a range; a long stretch has a state per range.
    """
    missing = [name for name in order if name not in df.columns]
    if missing:
        raise ValueError(f"unknown order columns: {missing}")
    spark, keys = df.sparkSession, [f"k{i}" for i in range(len(order))]
    digest = sha256_text(row_text(df))
    number = lambda start: F.conv(F.substring("_digest", start, DIGITS), 16, 10).cast("bigint")
    part = F.coalesce(stretch.cast("string"), F.lit("~")) if stretch is not None else F.lit("")
    keyed = df.select(part.alias("stretch"), *[F.col(c).alias(k) for c, k in zip(order, keys)], digest.alias("_digest"))
    keyed = keyed.select("stretch", *keys, number(1).alias("d0"), number(1 + DIGITS).alias("d1"), F.monotonically_increasing_id().alias("_row"))
    path = new_location(spark, "sequence-keys")
    keyed.write.parquet(path)
    # The stored row number only deals out equal rows; which of them comes first changes nothing.
    rows = spark.read.schema(keyed.schema).parquet(path)
    by = [*keys, "d0", "d1", "_row"]
    key_type = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.select(*keys, "d0", "d1").schema)
    schema = f"stretch string, first struct<{key_type}>, last struct<{key_type}>, row_count bigint, h0 bigint, h1 bigint"
    in_order = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("stretch", *keys, "d0", "d1")
    count = len(keys)
    return in_order.mapInArrow(lambda batches: _states(batches, count), schema)


def _power(point: int, exponent: Column) -> Column:
    """point ^ exponent modulo the prime, from the squares of its 48 lowest bits."""
    squares, square = [], point
    for _ in range(48):
        squares.append(F.lit(square).cast(_WIDE))
        square = square * square % PRIME
    chosen = F.filter(F.sequence(F.lit(0), F.lit(47)), lambda i: F.getbit(exponent.cast("bigint"), i) == 1)
    prime = F.lit(PRIME).cast(_WIDE)
    return F.aggregate(chosen, F.lit(1).cast(_WIDE), lambda a, i: ((a * F.element_at(F.array(*squares), i + 1)) % prime).cast(_WIDE))


def fold_states(states: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """One row per group of states: row_count, h0, h1, in_order and content_hash.

    The states of a group, one per stretch and range, are put in the order of their first keys. If one begins before the one before it
    has ended, ``in_order`` is false and the hash is null: the overlapping stretches must be hashed together.
    """
    by_key = Window.partitionBy(*group).orderBy("first", "last")
    later = F.coalesce(F.sum("row_count").over(by_key.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    placed = states.withColumns({"_later": later, "_fits": F.coalesce(F.lag("last").over(by_key) <= F.col("first"), F.lit(True))})
    prime = F.lit(PRIME).cast(_WIDE)
    moved = placed.withColumns({f"_m{k}": ((F.col(f"h{k}").cast(_WIDE) * _power(p, F.col("_later"))) % prime).cast("decimal(20,0)") for k, p in enumerate(POINTS)})
    sums = [(F.sum(f"_m{k}").cast(_WIDE) % prime).cast("bigint").alias(f"h{k}") for k in (0, 1)]
    folded = moved.groupBy(*group).agg(F.sum("row_count").alias("row_count"), *sums, F.bool_and("_fits").alias("in_order"))
    return folded.withColumn("content_hash", F.when(F.col("in_order"), sequence_digest()))


def sequence_digest() -> Column:
    return sha256_text(F.concat_ws("|", F.col("row_count").cast("string"), F.col("h0").cast("string"), F.col("h1").cast("string")))


def replace_states(states: DataFrame, new: DataFrame) -> DataFrame:
    """``states`` with the stretches of ``new`` in place of their earlier ones."""
    return states.join(new.select("stretch").distinct(), "stretch", "left_anti").unionByName(new)
