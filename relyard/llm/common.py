"""What several corpus operators share: the text columns, stored intermediates, hold-out split."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relyard.session import new_location


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone: other columns, whatever their names, neither travel nor clash. Null text is empty."""
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once below the shared folder and go on from the files.

    Cuts the lineage, so that nothing expensive runs twice and a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = new_location(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch that stand as Python values at a time.
ROWS = 512


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices, none left out. A batch of 10,000 texts as Python values, and what is made of them, takes hundreds of MB."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Text of a batch that is worked on at a time.
TEXT_BYTES = 6 << 20


def few_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows that start within the same ``most`` bytes of text, none left out."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
        for first, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(first, end - first)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """Documents never learned from: a quarter, by a hash of the id. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def row_key(doc_id, text) -> Column:
    """A hash of a row's id and text. Together with the id it names the row; rows equal in both are repeated rows."""
    return F.xxhash64(doc_id, text).alias("row_key")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on row key and id; null ids meet too."""
    return (left["row_key"] == right["row_key"]) & left["doc_id"].eqNullSafe(right["doc_id"])


#: Row keys that are broadcast, some 30 bytes each.
KEYS_SENT = 1_000_000


def within_reach(keys: DataFrame, most: int = KEYS_SENT) -> bool:
    """Whether a stored table of row keys is small enough to be broadcast: it is counted, never guessed."""
    return keys.count() <= most


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
