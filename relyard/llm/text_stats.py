"""Counts over whole texts that quality rules and the quality classifier read. One Arrow pass, no shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from relyard.llm.common import few_rows, texts

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_distinct",
)
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def repeated_words(words: list) -> int:
    """Words inside a window of three that is found at least twice in the text, first places included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered = np.zeros(len(words), bool)
    places = np.flatnonzero(np.fromiter((found[w] > 1 for w in windows), bool, len(windows)))
    for step in range(3):
        covered[places + step] = True
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The values of ``COUNTS``. Words end at ASCII white space; letters are ASCII letters and all non-ASCII characters."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper = int(codes[65:91].sum())
    return (
        len(words),
        len(text) - sum(int(codes[ord(c)]) for c in SPACES),
        sum(int(codes[ord(c)]) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper + int(codes[97:123].sum()) + int(codes[0xC0:].sum()),
        upper,
        len(set(words)),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *count_arrays(batch.column(1))], ["doc_id", *COUNTS])


def count_arrays(column: pa.Array) -> list[pa.Array]:
    rows = [text_counts(text) for text in column.to_pylist()]
    return [pa.array(values) for values in np.array(rows, np.int64).reshape(len(rows), len(COUNTS)).T]


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` for every row; null text counts as empty."""
    return texts(docs).mapInArrow(_count, SCHEMA)


def with_counts(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with one more column, a struct of ``COUNTS``, under a name that is free."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            text = batch.column(place)
            counts = count_arrays(text.fill_null("") if text.null_count else text)
            struct = pa.StructArray.from_arrays(counts, names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    place = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(name, StructType([StructField(c, LongType()) for c in COUNTS]))])
    return docs.mapInArrow(add, schema)
