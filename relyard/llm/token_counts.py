"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled as such.

1. One pass over all documents counts text units in each task and keeps the ``PER_TASK`` most frequent; those few rows
   are summed, and the ``frequent`` most frequent units of the corpus get their token counts once, on the driver.
2. That table (bounded by ``frequent`` rows, some 100 KB) is broadcast. Every other unit is encoded by the worker that
   meets it, which keeps up to ``tokens.CACHED_UNITS`` of them.

The table only decides what is fast; every count is that of the library (see ``tokens``).

``count_tokens(docs)`` returns one row per input row: doc_id, n_bytes, n_tokens, over_limit. Null text counts as empty (0 bytes,
0 tokens); null ids and repeated rows are kept as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from relyard.llm import tokens
from relyard.llm.common import texts

FREQUENT = 20_000
PER_TASK = 4_000
COUNTED_UNITS = 200_000
LIMIT = 1024
COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Most frequent units of a task. Rare ones are dropped whenever the counter grows too large (lossy counting)."""
    counted: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counted.update(tokens.ByteLengths.split(text))
            floor = 1
            while len(counted) > COUNTED_UNITS:
                counted = Counter({unit: n for unit, n in counted.items() if n > floor})
                floor *= 2
    top = counted.most_common(PER_TASK)
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["unit", "n"])


def frequent_units(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    counts = texts(docs).select("text").mapInArrow(task_counts, "unit string, n bigint")
    top = counts.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(most)
    return [row.unit for row in top.select("unit").collect()]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    encoder = tokens.ByteLengths(path)
    units = frequent_units(docs, frequent)
    table = {u: encoder._unit(u) for u in units if encoder.units and encoder.plain(u)}
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker_encoder(path, sent)
        for batch in batches:
            n = [own(text) for text in batch.column(1).to_pylist()]
            size = pc.binary_length(batch.column(1)).cast(pa.int64())
            columns = [batch.column(0), size, pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(count, COUNTS)


_ENCODERS: dict[str, tokens.ByteLengths] = {}


def _worker_encoder(path: str, sent) -> tokens.ByteLengths:
    """The worker's encoder: its cache outlives a task; a new broadcast table is added to it once."""
    own = _ENCODERS.setdefault(path, tokens.ByteLengths(path))
    if getattr(own, "table", None) is not sent:
        own.kept.update(sent.value)
        own.table = sent
    return own
