"""Token ids of a corpus as wavelet-matrix files, written and read back by Spark.

Documents are range-partitioned by id and sorted, encoded where they are, and cut into shards of at least ``SHARD_TOKENS`` tokens (whole
documents), so memory per task does not depend on the partition. A shard is one block of bytes in the form of ``wavelet``; a task's shards are
rows of one Parquet file, so writing is committed, retried and read by Spark on any store.

``write_tokens(docs, vocabulary, path)`` writes, ``read_documents(spark, path)`` decodes the files to one row per document: doc_id, start (ids of all
documents before it), n_tokens, ids (little-endian unsigned 32-bit). ``lookup(spark, path, token)`` counts a token and lists its places.

Defined cases: null text counts as empty (its end id alone); null ids come first; rows that share an id follow the order of their texts and repeated rows
are stored again; an empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from relyard.llm import tokens
from relyard.llm.common import few_bytes, texts
from relyard.llm.wavelet import WaveletMatrix

SHARD_TOKENS = 1_000_000
END_ID = 2
STORE = "part int, shard int, first_doc bigint, start_in_part bigint, n_tokens bigint, payload binary"
STORE_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]
)
DOCUMENTS = "part int, doc_id bigint, at bigint, n_tokens bigint, ids binary"


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    end = np.array([end_id], "<u4").tobytes()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = tokens.word_ids(vocabulary), TaskContext.get().partitionId()
        shard, written, ids, doc_ids, held = 0, 0, [], [], 0

        def block() -> pa.RecordBatch:
            sequence = np.frombuffer(b"".join(ids), "<u4")
            payload = WaveletMatrix.of(sequence, doc_ids, [len(i) // 4 for i in ids]).to_bytes()
            row = ([part], [shard], [doc_ids[0]], [written], [len(sequence)], [payload])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, STORE_ARROW)], schema=STORE_ARROW)

        for batch in few_bytes(batches):
            for doc_id, own in zip(batch.column(0).to_pylist(), encode.many(batch.column(1))):
                ids.append(own + end)
                doc_ids.append(doc_id)
                held += len(ids[-1]) // 4
                if held >= shard_tokens:
                    yield block()
                    shard, written, ids, doc_ids, held = shard + 1, written + held, [], [], 0
        if ids:
            yield block()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # The planes are compressed already; small row groups keep what a reader holds at once near 16 MB.
    ordered.mapInArrow(build, STORE).write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(path)


def part_starts(store: DataFrame) -> DataFrame:
    """Tokens before each part. One row per writing task, so neither the window nor the broadcast grows with the documents."""
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    store = spark.read.schema(STORE).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                matrix = WaveletMatrix.from_bytes(payload)
                ids, lengths = matrix.decode().tobytes(), matrix.lengths
                ends = np.cumsum(lengths)
                pieces = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [np.full(len(lengths), part, np.int32), pa.array(matrix.doc_ids, pa.int64()), start + ends - lengths, lengths, pieces]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["part", "doc_id", "at", "n_tokens", "ids"],
                )

    documents = store.select("part", "start_in_part", "payload").mapInArrow(decode, DOCUMENTS)
    return documents.join(F.broadcast(part_starts(store)), "part").select(
        "doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids"
    )


def lookup(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Places of a token in the whole sequence, one row each, found by rank and select without decoding a shard."""
    store = spark.read.schema(STORE).parquet(path)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                places = start + np.array(WaveletMatrix.from_bytes(payload).occurrences(token), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), part, np.int32)), pa.array(places)], ["part", "at"])

    found = store.select("part", "start_in_part", "payload").mapInArrow(find, "part int, at bigint")
    return found.join(F.broadcast(part_starts(store)), "part").select((F.col("part_start") + F.col("at")).alias("place"))
