"""Substring de-duplication by hashed units: lines, and the sentences inside longer lines.

A unit ends at a newline; inside a line a sentence ends at a space after ``. ! ?``. A line of at least ``min_words`` words is a unit; so is each
sentence of that length inside it, alone and once more together with the shorter sentences that follow it, so that a passage set into
other text loses its short sentences too. Units are normalised (lower case, single spaces) and get a 128-bit digest. Globally the earliest occurrence of a digest by (doc_id, text hash, start) stays
and every later one is removed. All kinds of units share one digest space and are decided at once. No sentence is lost everywhere: whatever is
removed has an equal sentence at an earlier place, and this chain ends at one that stays.

With ``runs`` the pipeline's stage also takes runs of clauses as units (``clause_runs``): a clause ends at a newline, a sentence end or a space after
``, ; :``, and from each clause on and back from each clause the shortest run of clauses of ``min_words`` words is a unit, across newlines too. What such
a run is depends on its own words only, so a repeated passage loses all but the first and last clauses that share words with their host.

Most units are found once and never travel. A first pass over the texts counts 64 bits of each digest, combined in a few rows and in the task; the digests
counted twice or more go into a Bloom filter, and the second pass cuts the units again and hands on those in the filter. Only they are
stored and shuffled, and all 128 bits decide. Beyond ``FILTERED`` digests (64 MB of bits) every unit is handed on. A digest's keeper is
a minimum, so a unit found in a third of all documents costs one row per task; the join that finds its later occurrences is left to
adaptive skew handling.

``repeated_spans(docs)`` returns one row per removed span: doc_id, start, length (code points of the original text), n_words, kept_doc_id,
kept_start. ``remove_spans(docs)`` returns ``docs`` with text (and n_chars, where there is one) after removal, the original kept in no way
changed elsewhere.

Defined cases: null text has no units and stays null. Documents with a null id rank last. Repeated rows (same id and text) are one document:
they lose the same spans and never each other's. A document that loses all its words this way is dropped by ``remove_spans``; one that
had none before stays. An empty table gives no rows. Other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from relyard.llm.common import KEYS_SENT, few_rows, row_key, same_row, stored, within_reach

MIN_WORDS = 8
SENTENCE_END = re.compile(r"([.!?]) ")
CLAUSE_END = re.compile(r"\n|(?<=[.!?,;:]) ")
#: Digests in the Bloom filter at most, bits and probes for each.
FILTERED, BITS_EACH, PROBES = 50_000_000, 10, 5
UNITS = "row_key bigint, high bigint, low bigint, start int, length int, n_words int"


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, str]]:
    """(start, length, words, normalised text) of each unit; one that is a whole line is listed once."""
    found, start = [], 0
    for line in text.split("\n"):
        words = line.lower().split()
        if len(words) >= min_words:
            found.append((start, len(line), len(words), " ".join(words)))
            # Same length on purpose: offsets stay those of the text.
            sentences = SENTENCE_END.sub("\\1\n", line).split("\n")
            if len(sentences) > 1:
                found += _sentence_units(sentences, start, len(line), min_words)
        start += len(line) + 1
    return found


def _sentence_units(sentences: list[str], start: int, line_length: int, min_words: int) -> list[tuple[int, int, int, str]]:
    """Units of one line: each long sentence, and it with its short followers."""
    found, at = [], start
    long_at, group = None, []  # the last long sentence and the words from there on

    def close(end: int, followers: bool) -> None:
        if long_at is not None and followers and end - long_at < line_length:
            found.append((long_at, end - long_at, len(group), " ".join(group)))

    followers = False
    for sentence in sentences:
        words = sentence.lower().split()
        if len(words) >= min_words:
            close(at - 1, followers)
            found.append((at, len(sentence), len(words), " ".join(words)))
            long_at, group, followers = at, words, False
        else:
            group, followers = group + words, True
        at += len(sentence) + 1
    close(at - 1, followers)
    return found


def clause_runs(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, str]]:
    """(start, length, words, normalised text) of the shortest run of clauses from each clause on, and back from each, each run once."""
    clauses, at = [], 0
    for end, following in [*((m.start(), m.end()) for m in CLAUSE_END.finditer(text)), (len(text), 0)]:
        if words := text[at:end].lower().split():
            clauses.append((at, end, words))
        at = following
    runs, first, n = set(), 0, 0
    for last, (_, _, words) in enumerate(clauses):
        n += len(words)
        while n >= min_words:  # the shortest from ``first`` on ends here
            runs.add((first, last))
            n -= len(clauses[first][2])
            first += 1
    last, n = len(clauses) - 1, 0
    for first in range(len(clauses) - 1, -1, -1):
        n += len(clauses[first][2])
        while n >= min_words:
            runs.add((first, last))
            n -= len(clauses[last][2])
            last -= 1
    found = []
    for first, last in sorted(runs):
        words = [w for _, _, part in clauses[first : last + 1] for w in part]
        found.append((clauses[first][0], clauses[last][1] - clauses[first][0], len(words), " ".join(words)))
    return found


def all_units(text: str, min_words: int, runs: bool) -> list[tuple[int, int, int, str]]:
    found = units(text, min_words)
    if runs:
        there = {x[:2] for x in found}
        found += [x for x in clause_runs(text, min_words) if x[:2] not in there]
    return found


def _given(docs: DataFrame) -> DataFrame:
    doc_id = docs["doc_id"].cast("bigint")
    return docs.where(docs["text"].isNotNull()).select(doc_id.alias("doc_id"), row_key(doc_id, docs["text"]), "text")


def _digest(normal: str) -> bytes:
    return xxhash.xxh3_128_digest(normal.encode("utf-8", "surrogatepass"))


def document_units(docs: DataFrame, min_words: int, runs: bool = False, wanted: Broadcast | None = None) -> DataFrame:
    """doc_id and ``UNITS`` of every document, or of its units in the broadcast filter; the texts stay where they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(batches):
            rows, digests = [], []
            for doc, text in enumerate(part.column(2)):
                for start, length, n_words, normal in all_units(text.as_py(), min_words, runs):
                    rows.append((doc, start, length, n_words))
                    digests.append(_digest(normal))
            numbers = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            places = np.array(rows, np.int32).reshape(-1, 4)
            if wanted is not None:
                there = in_filter(wanted.value, numbers[:, 1])
                numbers, places = numbers[there], places[there]
            owner = pa.array(places[:, 0])
            columns = [part.column(0).take(owner), part.column(1).take(owner), *(pa.array(np.ascontiguousarray(c)) for c in (*numbers.T, *places.T[1:]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "high", "low", "start", "length", "n_words"])

    return _given(docs).mapInArrow(cut, f"doc_id bigint, {UNITS}")


def digest_counts(batches: Iterator[pa.RecordBatch], min_words: int, runs: bool) -> Iterator[pa.RecordBatch]:
    """(low, n) for the digests in each few rows of (text); n is 2 for more."""
    for part in few_rows(batches):
        low = [_digest(u[3])[8:] for text in part.column(0) for u in all_units(text.as_py(), min_words, runs)]
        found, n = np.unique(np.frombuffer(b"".join(low), ">i8").astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.minimum(n, 2).astype(np.int8))], ["low", "n"])


def repeated_digests(docs: DataFrame, min_words: int, runs: bool = False) -> DataFrame:
    """(low): the last 64 bits of every digest that stands for two units or more."""
    counted = _given(docs).select("text").mapInArrow(lambda batches: digest_counts(batches, min_words, runs), "low bigint, n tinyint")
    return counted.groupBy("low").agg(F.sum("n").alias("n")).where("n > 1").select("low")


def _bits(low: np.ndarray, words: int) -> np.ndarray:
    """Places of each digest in a filter of ``words`` (a power of two) times 64 bits, a row per probe."""
    h = low.view(np.uint64)
    step = h >> np.uint64(32) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(64 * words - 1) for k in range(PROBES)])


def in_filter(words: np.ndarray, low: np.ndarray) -> np.ndarray:
    there = np.ones(len(low), bool)
    for bits in _bits(np.ascontiguousarray(low), len(words)):
        there &= (words[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) == 1
    return there


def digest_filter(repeated: DataFrame, n: int) -> np.ndarray:
    """Bloom filter of ``n`` stored digests: its words are put together by a grouped OR, and only words with a bit come to the driver."""
    size = 1 << max(4, (n * BITS_EACH // 64).bit_length())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(), size).ravel()
            masks = (np.uint64(1) << (bits & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int64)), pa.array(masks)], ["word", "mask"])

    found = repeated.mapInArrow(words, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(size, np.uint64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, runs: bool = False, filtered: int = FILTERED) -> DataFrame:
    """The units of ``document_units`` that are found twice or more, and a few in a hundred of the others."""
    repeated = stored(repeated_digests(docs, min_words, runs), "repeated-digests")
    n = repeated.count()
    wanted = docs.sparkSession.sparkContext.broadcast(digest_filter(repeated, n)) if n <= filtered else None
    return document_units(docs, min_words, runs, wanted)


def later_occurrences(docs: DataFrame, min_words: int = MIN_WORDS, runs: bool = False, filtered: int = FILTERED) -> DataFrame:
    """Occurrences that are not the earliest of their digest, with the place of the earliest."""
    found = stored(repeated_units(docs, min_words, runs, filtered), "units")
    # Places are worked out on both sides of the shuffles, as they are wider than what they are made of.
    first = found.groupBy("high", "low").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = first.where("n > 1").select("high", "low", "first")
    return found.join(repeated, ["high", "low"]).where(_place() != F.col("first")).drop("high", "low")


def _no_id() -> Column:
    """Above every bigint, so that documents without an id rank last."""
    return F.lit(str(1 << 63)).cast("decimal(20,0)")


def _place() -> Column:
    """Rank of an occurrence as one number, so that minima are taken in a hash table: id, 16 bits of the row key, start."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), _no_id())
    text = F.col("row_key").bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 31) + F.col("start")
    return (doc * F.lit(1 << 47).cast("decimal(15,0)") + text.cast("decimal(18,0)")).cast("decimal(38,0)")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    kept_doc = F.floor(F.col("first") / F.lit(1 << 47)).cast("decimal(20,0)")
    spans = later_occurrences(docs, min_words).select(
        "doc_id",
        "row_key",
        "start",
        "length",
        "n_words",
        F.when(kept_doc < _no_id(), kept_doc).cast("bigint").alias("kept_doc_id"),
        F.pmod("first", F.lit(1 << 31)).cast("int").alias("kept_start"),
    )
    # A repeated row shows its spans once.
    return spans.distinct().drop("row_key")


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a unit's closing newline or space goes with it."""
    kept, at = [], 0
    for start, length in sorted(spans):
        if start > at:
            kept.append(text[at:start])
        at = max(at, min(len(text), start + length + 1))
    kept.append(text[at:])
    return "".join(kept).rstrip("\n ") if at >= len(text) else "".join(kept)


def remove_spans(docs: DataFrame, min_words: int = MIN_WORDS, runs: bool = False, sent: int = KEYS_SENT) -> DataFrame:
    """While at most ``sent`` rows lose a span, only those rows are moved to meet their spans; the others stay where they are."""
    spans = F.collect_set(F.struct("start", "length")).alias("spans")  # of one document, so bounded by its length
    found = stored(later_occurrences(docs, min_words, runs).groupBy("row_key", "doc_id").agg(spans), "spans")
    doc_id = docs["doc_id"].cast("bigint")
    packed = docs.select(doc_id.alias("doc_id"), row_key(doc_id, docs["text"]), docs["text"].alias("body"), F.struct("*").alias("row"))
    if within_reach(found, sent):
        keys = F.broadcast(found.select("row_key", "doc_id"))
        hit, rest = packed.join(keys, same_row(packed, keys), "left_semi"), packed.join(keys, same_row(packed, keys), "left_anti")
        marked = hit.join(found.hint("merge"), same_row(hit, found)).select("row", "body", "spans")
        return rest.select("row.*").union(_without_spans(docs, marked))
    return _without_spans(docs, packed.join(found, same_row(packed, found), "left").select("row", "body", "spans"))


def _without_spans(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows (row, body, spans) with their spans cut out; those that lose all their words are dropped."""

    @F.pandas_udf("string")
    def without(bodies: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([b if s is None else cut_out(b, [(x["start"], x["length"]) for x in s]) for b, s in zip(bodies, spans)], dtype=object)

    # Not deterministic in name only: the filter below must not run the function a second time.
    cut = marked.withColumn("body", without.asNondeterministic()("body", "spans"))
    cut = cut.where(F.col("spans").isNull() | F.col("body").rlike(r"\S"))
    row = F.col("row").withField("text", F.col("body"))
    if "n_chars" in docs.columns:
        length = F.length("body").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(length))
    return cut.select(row.alias("row")).select("row.*")


def oracle(min_words: int = MIN_WORDS) -> str:
    """The same spans by grouping the normalised texts themselves."""
    words = r"list_filter(regexp_split_to_array(lower(unit), '\s+'), lambda x: x <> '')"
    before = "coalesce(sum(length(unit) + 1) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    split = r"regexp_replace(unit, '([.!?]) ', '\1' || chr(10), 'g')"
    return f"""
    WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    l AS (SELECT doc_id, i, unit, {before.format(key='doc_id')} AS start, {words} AS w FROM l0),
    s0 AS (SELECT doc_id, i AS line, start AS line_start, unnest(string_split({split}, chr(10))) AS unit,
                  generate_subscripts(string_split({split}, chr(10)), 1) AS i FROM l WHERE contains({split}, chr(10))),
    s AS (SELECT doc_id, line, i, line_start, line_start + {before.format(key='doc_id, line')} AS start, unit, {words} AS w FROM s0),
    g AS (SELECT s.doc_id, s.start, l.start AS line_start, l.unit AS line, coalesce(lead(s.start) OVER k - 1, l.start + length(l.unit)) AS till, s.unit
          FROM s JOIN l ON l.doc_id = s.doc_id AND l.i = s.line WHERE len(s.w) >= {min_words} WINDOW k AS (PARTITION BY s.doc_id, s.line ORDER BY s.i)),
    c AS (SELECT doc_id, start, substr(line, (start - line_start)::int + 1, (till - start)::int) AS unit
          FROM g WHERE till - start > length(unit) AND till - start < length(line)),
    u AS (SELECT doc_id, start, unit, w FROM l UNION ALL SELECT doc_id, start, unit, w FROM s UNION ALL SELECT doc_id, start, unit, {words} AS w FROM c),
    n AS (SELECT doc_id, start::int AS start, length(unit)::int AS length, len(w)::int AS n_words, array_to_string(w, ' ') AS normal
          FROM u WHERE len(w) >= {min_words}),
    f AS (SELECT *, first_value(doc_id) OVER k AS kept_doc_id, first_value(start) OVER k AS kept_start
          FROM n WINDOW k AS (PARTITION BY normal ORDER BY doc_id, start))
    SELECT DISTINCT doc_id, start, length, n_words, kept_doc_id, kept_start FROM f WHERE doc_id <> kept_doc_id OR start <> kept_start"""
