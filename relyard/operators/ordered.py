"""Exact ordered operators (rank, running sums, neighbours, as-of) that survive hot groups.

A plain window over a group sorts that whole group in one task. That is the cheapest plan while every
group is small, so it is taken only after measuring the largest group; once one group holds more than
``MAX_ROWS_PER_TASK`` rows (a third of a big table, say) the rows are split into *bins*: columns that
never decrease along the wanted order (a day, a hash prefix, a score band), coarse to fine. Rows are then
sorted only inside (group, bins); what happened in earlier bins comes from a table with one row per
(group, bins), aggregated before it is shuffled and worked through the same way one bin level up. The row
side is shuffled once, by (group, bins), and the join back uses that same distribution.

Both ways give the same rows. Group and bin columns hold no nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


MAX_ROWS_PER_TASK = 4_000_000

def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group: one pass over the key columns, taken anew each time, as tables grow."""
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def needed_bins(
    df: DataFrame, group: Sequence[str], bins: Sequence[str], max_rows: int | None = None
) -> list[str]:
    """The fewest leading bins that leave no (group, bins) too large for one task; none if groups are small.

    Without group columns at least the first bin is kept, so nothing is ever sorted as a whole.
    """
    limit = MAX_ROWS_PER_TASK if max_rows is None else max_rows
    for used in range(0 if group else 1, len(bins)):
        if largest_group(df, [*group, *bins[:used]]) <= limit:
            return list(bins[:used])
    return list(bins)


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    bins: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Add, for each output name, the sum of its expression over all *earlier* rows of the group.

    ``order`` must be a total order inside a bin, or rows that tie must carry equal meaning.
    """
    keys = [*group, *bins]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if not bins:
        return df.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(n) for n, x in sums.items()])
    local = df.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"_in_{n}") for n, x in sums.items()])
    totals = df.groupBy(*keys).agg(*[F.sum(x).alias(f"_of_{n}") for n, x in sums.items()])
    before = running_sums(totals, group, bins[:-1], [bins[-1]], {f"_to_{n}": F.col(f"_of_{n}") for n in sums})
    before = before.drop(*[f"_of_{n}" for n in sums])
    return local.join(before, keys).select(
        *df.columns, *[(F.col(f"_to_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums]
    )


def exact_rank(
    df: DataFrame, group: Sequence[str], bins: Sequence[str], order: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """1-based row number of every row inside its group."""
    ranked = running_sums(df, group, bins, order, {name: F.lit(1).cast("bigint")})
    return ranked.withColumn(name, F.col(name) + 1)


def previous_values(
    df: DataFrame,
    group: Sequence[str],
    bins: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
) -> DataFrame:
    """``lag`` over a group: output name -> column of the row just before; null for the first row."""
    keys = [*group, *bins]
    held = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    local = df.select("*", F.lag(held).over(Window.partitionBy(*keys).orderBy(*order)).alias("_near"))
    found = F.col("_near")
    if bins:
        last_in_bin = df.groupBy(*keys).agg(F.max_by(held, F.struct(*order)).alias("_last"))
        earlier = previous_values(last_in_bin, group, bins[:-1], [bins[-1]], {"_earlier": "_last"}).drop("_last")
        local = local.join(earlier, keys)
        found = F.coalesce(found, F.col("_earlier"))
    return local.select(*df.columns, *[found[name].alias(name) for name in values])


def latest_before(
    df: DataFrame,
    group: Sequence[str],
    bins: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    strict: bool = False,
) -> DataFrame:
    """Carry the last non-null ``value`` at or before each row: the union form of an as-of join.

    ``strict`` leaves the row itself out.
    """
    keys = [*group, *bins]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    local = df.select("*", F.last(value, ignorenulls=True).over(inside).alias("_near"))
    found = F.col("_near")
    if bins:
        at = F.when(F.col(value).isNotNull(), F.struct(*order))
        last_in_bin = df.groupBy(*keys).agg(F.max_by(value, at).alias("_last"))
        carried = latest_before(last_in_bin, group, bins[:-1], [bins[-1]], "_last", "_carried", strict=True)
        local = local.join(carried.drop("_last"), keys)
        found = F.coalesce(found, F.col("_carried"))
    return local.select(*df.columns, found.alias(name))


def score_band(score: Column, steps: int = 64) -> Column:
    """Non-decreasing band of a probability on the log-odds scale, ``steps`` bands per unit.

    Sigmoid scores pile up near 0 and 1; equal steps of log-odds keep those piles apart. At 64 steps
    about 50,000 bands cover every double between 0 and 1.
    """
    inside = F.least(F.greatest(score, F.lit(1e-300)), F.lit(1.0 - 1e-16))
    return F.floor(F.ln(inside / (F.lit(1.0) - inside)) * steps)


#: Largest lookup that is broadcast, in estimated bytes, and rows of one key that one task joins beyond that.
MAX_BROADCAST_BYTES = 64 << 20
ROWS_PER_SALT = 1_000_000
STREAM_SALTS = 16


def estimated_bytes(df: DataFrame) -> int:
    """Rows of a table as text, added up: an upper guess of what a broadcast of it takes, in one pass."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32)
    return df.agg(size).first()[0] or 0


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    max_broadcast_bytes: int | None = None,
    rows_per_salt: int | None = None,
    lookup_bytes: int | None = None,
) -> DataFrame:
    """Equi-join facts to a table with unique keys when single keys may hold much of the facts.

    The lookup is measured first, unless the caller knows its size (``lookup_bytes``). Up to ``MAX_BROADCAST_BYTES`` it is broadcast and the facts do not move at all. Beyond that
    the facts are counted by key, and only keys with more than ``ROWS_PER_SALT`` rows are spread, each over as many
    partitions as its rows ask for; their lookup rows are repeated that often.
    """
    limit = MAX_BROADCAST_BYTES if max_broadcast_bytes is None else max_broadcast_bytes
    if (estimated_bytes(lookup) if lookup_bytes is None else lookup_bytes) <= limit:
        return facts.join(F.broadcast(lookup), list(on), how)
    per_salt = ROWS_PER_SALT if rows_per_salt is None else rows_per_salt
    if facts.isStreaming:  # a stream cannot be counted beforehand; a micro-batch is small
        salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(STREAM_SALTS)).cast("int"))
        repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(STREAM_SALTS - 1))))
        return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
    counted = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > per_salt)
    # At most one row per ``per_salt`` facts, and again measured before it is broadcast.
    hot = counted.select(*on, F.ceil(F.col("_n") / per_salt).cast("int").alias("_salts"))
    small = F.broadcast(hot) if estimated_bytes(hot) <= MAX_BROADCAST_BYTES else hot
    salts = F.coalesce("_salts", F.lit(1))
    salted = facts.join(small, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop("_salts")
    repeated = lookup.join(small, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
