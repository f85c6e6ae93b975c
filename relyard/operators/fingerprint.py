"""Dataset, schema and config fingerprints, and validation of stored contracts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relyard import constants as c
from relyard.functions.hashing import DIGEST_SUMS, digest_sums, finish_digest, json_quoted, row_text, sha256_text
from relyard.functions.text import strip_or_null
from relyard.operators.ordered import exact_rank, needed_bins


def hash_type(spark_type: str) -> str:
    return c.HASH_TYPE_NAMES.get(spark_type, "object")


def schema_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of each table, from metadata."""
    rows = [
        (name, pos, column, hash_type(data_type))
        for name, df in tables.items()
        for pos, (column, data_type) in enumerate(df.dtypes)
    ]
    return spark.createDataFrame(rows, "table_name string, pos int, column_name string, data_type string")


def schema_hash(columns: DataFrame) -> DataFrame:
    """sha256 of the compact JSON list of [name, type] pairs; column order matters."""
    pair = F.concat(F.lit("["), json_quoted(F.col("column_name")), F.lit(","), json_quoted(F.col("data_type")), F.lit("]"))
    ordered = F.sort_array(F.collect_set(F.struct(F.col("pos"), pair.alias("pair"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["pair"]), ","), F.lit("]"))
    return columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"), sha256_text(text).alias("schema_hash"))


def schema_text(df: DataFrame) -> str:
    return json.dumps([[name, hash_type(t)] for name, t in df.dtypes], separators=(",", ":"))


def content_sums(df: DataFrame, group: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Additive multiset hash state; sums of two parts are the state of their union."""
    names = [n for n in (columns or df.columns) if n not in group]
    return df.groupBy(*group).agg(*digest_sums(sha256_text(row_text(df, names))))


def combine_sums(sums: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return sums.groupBy(*group).agg(*[F.sum(n).alias(n) for n in ("row_count", *DIGEST_SUMS)])


def content_hash_multiset(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Hash that ignores row and column order but counts duplicates."""
    return content_sums(df, group).select(*group, "row_count", finish_digest().alias("content_hash"))


def content_hash_ordered(df: DataFrame, order: Sequence[str], bins: Sequence[Column]) -> DataFrame:
    """Hash that depends on row order, given by the ``order`` columns, and not on column order.

    Each row's digest is hashed with its exact 0-based position; positions come from a two-level rank over
    ``bins``, so there is no global sort and only keys and digests are shuffled. Rows that share a key follow the order of
    their digests, so the hash never depends on how the rows arrive. Unknown columns are an error that lists them.
    """
    missing = [name for name in order if name not in df.columns]
    if missing:
        raise ValueError(f"unknown order columns: {missing}")
    rows = df.select(
        *order, sha256_text(row_text(df)).alias("_digest"), *[b.alias(f"_bin{i}") for i, b in enumerate(bins)]
    )
    used = needed_bins(rows, [], [f"_bin{i}" for i in range(len(bins))])
    ranked = exact_rank(rows, [], used, [*order, "_digest"], "_position")
    digest = sha256_text(F.concat_ws(":", (F.col("_position") - 1).cast("string"), "_digest"))
    return ranked.agg(*digest_sums(digest)).select("row_count", finish_digest().alias("content_hash"))


def dataset_fingerprint(parts: DataFrame, side: str, uri: str, git_sha: str | None) -> DataFrame:
    """Contract row over all parts (train and test, told apart by column ``side``).

    Content states per part are added up, so parts hashed earlier need not be read again.
    """
    data = parts.drop(side)
    return combine_sums(content_sums(parts, [side])).select(
        F.lit(c.DATASET_FINGERPRINT_VERSION).alias("schema_version"),
        default_git_sha(F.lit(git_sha).cast("string")).alias("git_sha"),
        finish_digest().alias("dataset_content_hash"),
        sha256_text(F.lit(schema_text(data))).alias("dataset_schema_hash"),
        "row_count",
        F.lit(uri).alias("data_source_uri"),
    )


def default_git_sha(*candidates: Column) -> Column:
    """First non-blank sha, else 'unknown'."""
    return F.coalesce(*[strip_or_null(x) for x in candidates], F.lit("unknown"))


TAG_FIELDS = ("git_sha", "dataset_content_hash", "dataset_schema_hash", "row_count", "data_source_uri")


def fingerprint_tags(fingerprints: DataFrame) -> DataFrame:
    """Five tags per fingerprint, all text; the contract version is not one of them."""
    pairs = [part for name in TAG_FIELDS for part in (F.lit(name), F.col(name).cast("string"))]
    return fingerprints.select(F.explode(F.create_map(*pairs)).alias("key", "value"))


def fingerprint_json() -> Column:
    """Contract as JSON with two-space indent and sorted keys."""

    def field(name: str, quoted: bool = True) -> Column:
        text = F.col(name).cast("string")
        return F.concat(F.lit(f'  "{name}": '), json_quoted(text) if quoted else text)

    lines = [
        field("data_source_uri"),
        field("dataset_content_hash"),
        field("dataset_schema_hash"),
        field("git_sha"),
        field("row_count", quoted=False),
        field("schema_version"),
    ]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def fingerprint_tag(fingerprints: DataFrame) -> DataFrame:
    """One hash over the whole contract; it changes with commit and location, not only with the data."""
    return fingerprints.select(sha256_text(fingerprint_json()).alias("dataset_fingerprint"))


def config_hash(long_params: DataFrame) -> DataFrame:
    """sha256 of each run's params (run_id, key, value, value_type) as compact sorted JSON.

    ``value_type`` 'number' and 'bool' print the value bare, any other as a JSON string; a null value is null.
    """
    bare = F.col("value_type").isin("number", "bool")
    shown = F.when(F.col("value").isNull(), F.lit("null")).when(bare, F.col("value")).otherwise(json_quoted(F.col("value")))
    named = long_params.select("run_id", "key", F.concat(json_quoted(F.col("key")), F.lit(":"), shown).alias("text"))
    pair = F.struct("key", "text")
    pairs = F.transform(F.sort_array(F.collect_set(pair)), lambda x: x["text"])
    text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return named.groupBy("run_id").agg(sha256_text(text).alias("config_hash"))


# Keys a stored contract must hold, by contract version.
REQUIRED_KEYS = {
    c.DATASET_FINGERPRINT_VERSION: (
        "git_sha", "dataset_content_hash", "dataset_schema_hash", "row_count", "data_source_uri",
    ),
    c.MODEL_REF_VERSION: ("model_name",),
    c.FEATURE_STATS_VERSION: (),
}


def validate_contracts(documents: DataFrame, expected: Column) -> DataFrame:
    """Error text per JSON document (column ``document``); null where the contract holds.

    ``expected`` names the contract version each document should follow. Optional reference fields
    that are '' come out as null.
    """
    parsed = documents.withColumn("_expected", expected).withColumn("_doc", F.try_parse_json("document"))

    def text(key: str) -> Column:
        return F.try_variant_get("_doc", f"$.{key}", "string")

    present = lambda key: F.try_variant_get("_doc", f"$.{key}", "variant").isNotNull()
    error = F.when(F.col("_doc").isNull(), F.lit("INVALID_JSON")).when(
        F.coalesce(text("schema_version"), F.lit("")) != F.col("_expected"), F.lit("UNSUPPORTED_SCHEMA_VERSION")
    )
    for version, keys in REQUIRED_KEYS.items():
        for key in keys:
            error = error.when((F.col("_expected") == version) & ~present(key), F.lit(f"MISSING_KEY {key}"))
    stats = F.try_variant_get("_doc", "$.stats", "variant")
    is_dict = F.coalesce(F.startswith(F.schema_of_variant(stats), F.lit("OBJECT")), F.lit(False))
    count = F.try_variant_get("_doc", "$.row_count", "bigint")
    error = error.when(
        (F.col("_expected") == c.FEATURE_STATS_VERSION) & ~is_dict, F.lit("STATS_NOT_A_DICT")
    ).when((F.col("_expected") == c.DATASET_FINGERPRINT_VERSION) & count.isNull(), F.lit("ROW_COUNT_NOT_A_NUMBER"))
    optional = [F.nullif(text(k), F.lit("")).alias(f"ref_{k}") for k in ("alias", "version", "source_run_id")]
    return parsed.select(*documents.columns, error.alias("error"), *optional)
