"""Packing documents into sequences of at most ``CAPACITY`` tokens by a grouping genetic algorithm.

1. ``pieces``: each document is encoded, gets its end id and is cut only if it is longer than a sequence. Pieces with their ids are
   written once; packing reads their lengths alone.
2. Full pieces are sequences of their own. The others are dealt by a hash into shards of about ``SHARD_PIECES``. Every shard is packed on
   ``ISLANDS`` islands, populations that evolve apart; their best solutions (elites) migrate to the next island and evolve on together with
   those at home; the best of all islands stands. Crossover injects whole well-filled bins, drops duplicates and best-fits displaced pieces.
3. Sequences still under ``FULL_SHARE`` full are opened, and their pieces are packed once more together, dealt into shards of the same size.

Seeds derive from shard and island, so a task repeated after a lost executor gives the same bins.

``pack(docs, vocabulary)`` returns one row per piece: doc_id, piece, start, length, ids, sequence_id, offset. Null text counts as empty: one piece, the end
id. Null ids and repeated rows are packed as documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from relyard.llm import bin_packing as ga, tokens
from relyard.llm.common import few_bytes, stored, texts

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 2_000
ISLANDS = 2
POPULATION = 4
ELITES = 2
GENERATIONS = 3
FULL_SHARE = 0.98
PIECES = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"
ELITE = "shard bigint, island int, elite int, uid bigint, length int, bin int"
PLACE = "uid bigint, length int, bin_id bigint, bin_fill int, offset bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``PIECES``: uid is the task's number and a running one, fixed by writing the table."""
    end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = tokens.word_ids(vocabulary), TaskContext.get().partitionId() << 36
        for batch in few_bytes(batches):
            rows = []
            for doc_id, own in zip(batch.column(0).to_pylist(), encode.many(batch.column(1))):
                ids = own + end
                for k, first in enumerate(range(0, len(ids), size)):
                    part = ids[first : first + size]
                    rows.append((uid, doc_id, k, first // 4, len(part) // 4, part))
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, schema)], schema=schema)

    schema = pa.schema(
        [("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    )
    return texts(docs).mapInArrow(cut, PIECES)


def _elite_rows(shard: int, island: int, people: list[ga.Bins], uids, lengths) -> pd.DataFrame:
    parts = []
    for k, bins in enumerate(people[:ELITES]):
        at = np.array([p for b in bins for p in b], np.int64)
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        parts.append(pd.DataFrame({"shard": shard, "island": island, "elite": k, "uid": uids[at], "length": lengths[at], "bin": number}))
    return pd.concat(parts)


def settle(capacity: int, generations: int):
    """A shard on one island: its first population."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        uids, lengths = rows["uid"].to_numpy(), rows["length"].to_numpy()
        rng = random.Random(f"{key[0]}/{key[1]}")
        people = ga.first_population(lengths.tolist(), capacity, POPULATION, rng)
        people = ga.evolve(people, lengths.tolist(), capacity, generations, rng)
        return _elite_rows(key[0], key[1], people, uids, lengths)

    return run


def _population(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[ga.Bins]]:
    uids, at = np.unique(rows["uid"].to_numpy(), return_inverse=True)
    lengths = np.zeros(len(uids), np.int64)
    lengths[at] = rows["length"].to_numpy()
    people = []
    for _, one in rows.assign(at=at).groupby(["origin", "elite"], sort=True):
        people.append([b.tolist() for _, b in one.sort_values(["bin", "uid"]).groupby("bin", sort=True)["at"]])
    return uids, lengths, people


def migrate(capacity: int, generations: int):
    """A shard on one island: the elites at home and those that have come evolve on."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        uids, lengths, people = _population(rows)
        rng = random.Random(f"{key[0]}/{key[1]}/migrated")
        people = ga.evolve(people, lengths.tolist(), capacity, generations, rng)
        return _elite_rows(key[0], key[1], people, uids, lengths)

    return run


def choose(capacity: int):
    """The best elite of all islands of a shard, with every piece's place."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        uids, lengths, people = _population(rows)
        best = max(people, key=lambda bins: ga.fitness(bins, lengths.tolist(), capacity))
        at = np.array([p for b in best for p in b], np.int64)
        sizes = [len(b) for b in best]
        number, size = np.repeat(np.arange(len(best)), sizes), lengths[at]
        ends = np.cumsum(size)
        firsts = np.cumsum(sizes) - sizes
        offset = ends - size - np.repeat((ends - size)[firsts], sizes)
        filled = np.add.reduceat(size, firsts)
        return pd.DataFrame(
            {"uid": uids[at], "length": size, "bin_id": (key[0] << 24) + number, "bin_fill": np.repeat(filled, sizes), "offset": offset}
        )

    return run


def pack_shards(lengths: DataFrame, capacity: int, shard_pieces: int) -> DataFrame:
    """``PLACE`` of every row of (uid, length); bins never cross a shard."""
    n_shards = max(1, -(-lengths.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("uid"), F.lit(n_shards)).cast("bigint").alias("shard")
    dealt = lengths.select(shard, "uid", F.col("length").cast("int").alias("length"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    settled = stored(dealt.groupBy("shard", "island").applyInPandas(settle(capacity, GENERATIONS), ELITE), "elites")
    here = settled.withColumn("origin", F.col("island"))
    moved = here.where("elite = 0").withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
    grown = here.union(moved).groupBy("shard", "island").applyInPandas(migrate(capacity, GENERATIONS), ELITE)
    return grown.withColumn("origin", F.col("island")).groupBy("shard").applyInPandas(choose(capacity), PLACE)


def places(lengths: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(uid, length) to (uid, sequence_id, offset)."""
    full = lengths.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    first = stored(pack_shards(lengths.where(F.col("length") < capacity), capacity, shard_pieces), "packed")
    done = F.col("bin_fill") >= F.lit(int(FULL_SHARE * capacity))
    again = pack_shards(first.where(~done).select("uid", "length"), capacity, shard_pieces)

    def numbered(df: DataFrame, kind: int) -> DataFrame:
        return df.select("uid", (F.col("bin_id") + F.lit(kind << 61)).alias("sequence_id"), "offset")

    return full.union(numbered(first.where(done), 1)).union(numbered(again, 2))


def stored_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``PIECES`` written once, so that nothing is encoded twice and every uid is fixed."""
    return stored(pieces(docs, vocabulary, capacity, end_id), "pieces", compression="zstd")


def with_places(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset instead of their uid. Whatever columns they carry travel along."""
    placed = places(cut.select("uid", "length"), capacity, shard_pieces)
    return cut.join(placed, "uid").drop("uid")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    return with_places(stored_pieces(docs, vocabulary, capacity, end_id), capacity, shard_pieces)
