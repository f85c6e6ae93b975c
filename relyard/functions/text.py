"""Text helpers: whitespace strip, blank tests, tag lookup, model URIs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def strip_or_empty(value: Column) -> Column:
    return F.coalesce(strip(value), F.lit(""))


def strip_or_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def tag(tags: Column, key: str) -> Column:
    """Tag text as stored, '' when the key (or the whole map) is missing."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def blank(value: Column) -> Column:
    return strip_or_empty(value) == ""


def gate_is_true(value: Column) -> Column:
    """The gate file counts as passed only when it says 'true' in any case."""
    return F.lower(strip_or_empty(value)) == "true"


def parse_model_uri(uri: Column) -> Column:
    """``models:/name@alias``, ``models:/name/version`` or ``runs:/id/model`` -> struct; '' becomes null."""

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(uri, pattern, 1), F.lit(""))

    return F.struct(
        part(r"^models:/([^@/]+)[@/].+$").alias("model_name"),
        part(r"^models:/[^@/]+@(.+)$").alias("alias"),
        part(r"^models:/[^@/]+/(\d+)$").try_cast("bigint").alias("version"),
        part(r"^runs:/([^/]+)/.+$").alias("run_id"),
    )
