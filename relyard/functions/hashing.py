"""Hash expressions. All are built-in column functions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SEPARATOR = "\x1f"
DIGEST_PIECES = 4
PIECE_DIGITS = 15
LIMB_BITS = 20
DIGEST_SUMS = tuple(f"s{i}" for i in range(13))
JSON_OPTIONS = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"}


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def _hex_number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10)


def bucket_of(seed: Column) -> Column:
    """Canary bucket of a text seed."""
    return bucket_of_digest(sha256_text(seed))


def bucket_of_digest(digest: Column) -> Column:
    """A sha256 hex digest mod 100 without big integers.

    The digest is read as 4 + 4x15 hex digits. 16^15k leaves 76 modulo 100 for every k >= 1, so the
    remainder of the whole number is a weighted sum of the remainders of the pieces.
    """
    pieces = [(1, 4), (5, 15), (20, 15), (35, 15), (50, 15)]
    rests = [_hex_number(digest, start, size).cast("bigint") % 100 for start, size in pieces]
    return ((F.lit(76) * (rests[0] + rests[1] + rests[2] + rests[3]) + rests[4]) % 100).cast("int")


def cell_text(column: str, data_type: str) -> Column:
    """Lossless text of one value, the same in every session: null is marked, separators inside text are escaped.

    Instants count as microseconds since 1970 and maps as their sorted entries, so neither the time zone nor the order of
    insertion shows.
    """
    value = F.col(f"`{column}`")
    if data_type == "string":
        text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit(SEPARATOR), F.lit("\\u"))
    elif data_type == "timestamp":
        text = F.unix_micros(value).cast("string")
    elif data_type.startswith("map"):
        text = F.to_json(F.array_sort(F.map_entries(value)), JSON_OPTIONS)
    elif data_type.startswith(("array", "struct")):
        if "map<" in data_type:
            raise ValueError(f"column {column}: a map inside {data_type} has no fixed order; unfold it first")
        text = F.to_json(value, JSON_OPTIONS)
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.lit("="), text), F.lit("~"))


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Cells joined in lexicographic column order, so column order does not matter."""
    types = dict(df.dtypes)
    names = sorted(columns if columns is not None else df.columns)
    return F.concat_ws(SEPARATOR, *[cell_text(name, types[name]) for name in names])


def digest_sums(digest: Column) -> list[Column]:
    """Order-free aggregates of row digests; add them up across partitions, days or tables.

    The 64 hex digits are read as four 60-bit numbers and one of 16 bits, and summed as thirteen limbs of at most 20
    bits: plain bigint sums are much cheaper than wide decimals and hold 8.8e12 rows before they would overflow,
    which raises an error.
    """
    mask = (1 << LIMB_BITS) - 1
    limbs = []
    for i in range(DIGEST_PIECES):
        piece = _hex_number(digest, 1 + i * PIECE_DIGITS, PIECE_DIGITS).cast("bigint")
        limbs += [
            F.shiftright(piece, 2 * LIMB_BITS),
            F.shiftright(piece, LIMB_BITS).bitwiseAND(mask),
            piece.bitwiseAND(mask),
        ]
    limbs.append(_hex_number(digest, 1 + DIGEST_PIECES * PIECE_DIGITS, 4).cast("bigint"))
    sums = [F.coalesce(F.sum(limb), F.lit(0)).alias(name) for limb, name in zip(limbs, DIGEST_SUMS)]
    return [F.count(F.lit(1)).alias("row_count"), *sums]


def finish_digest() -> Column:
    """Final hash of the columns made by :func:`digest_sums`."""
    parts = [F.col(name).cast("string") for name in ("row_count", *DIGEST_SUMS)]
    return sha256_text(F.concat_ws("|", *parts))


def json_quoted(text: Column) -> Column:
    """A text as a JSON string the way Python prints it. Only text beyond printable ASCII leaves the built-in form."""
    array = F.to_json(F.array(text))
    quoted = F.substring(array, F.lit(2), F.length(array) - 2)
    plain = ~text.rlike(r"[^\x20-\x7e]")
    return F.when(plain, quoted).otherwise(canonical_json(F.when(~plain, quoted)))


def canonical_json(payload: Column, member: str | None = None, indent: int | None = None) -> Column:
    """JSON with sorted keys and shortest float text, of the whole text or of one member of an object; compact or indented.

    Null where the text is not JSON or has no such member. Only for payloads with floats or non-ASCII text; integers,
    booleans and plain strings have a built-in form in :func:`relyard.operators.routing.canonical_rows`.
    """

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        import json

        def one(text):
            if text is None:
                return None
            try:
                value = json.loads(text)
                marks = (",", ":") if indent is None else None
                return json.dumps(value if member is None else value[member], sort_keys=True, separators=marks, indent=indent)
            except (TypeError, ValueError, KeyError):
                return None

        return texts.map(one)

    return canonical(payload)
