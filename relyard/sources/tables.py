"""Readers and writers: parquet tables, CSV copies, run log, JSON reports, input checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from relyard.functions.hashing import canonical_json


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, with the schema its files have now."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def require_columns(df: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    """Fail before any job starts when an expected column is not there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Expected column(s) {missing} in {source}")
    return df


def write_raw(df: DataFrame, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Keep the ingested dataset as it came and go on from the stored copy; without the required columns nothing is written."""
    require_columns(df, required, path).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header and a given schema: inference would scan twice and narrow bigint to int."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("cols"))


def run_log_long(runs: DataFrame) -> DataFrame:
    """Tags, params and metrics of every run as one long key-value table, in one pass over the runs."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def entries(kind: str, column: str, is_text: bool) -> Column:
        return F.transform(
            F.map_entries(column),
            lambda e: F.struct(
                F.lit(kind).alias("kind"),
                e["key"].alias("key"),
                (e["value"] if is_text else text).alias("value"),
                (number if is_text else e["value"]).alias("metric_value"),
            ),
        )

    every = F.concat(entries("tag", "tags", True), entries("param", "params", True), entries("metric", "metrics", False))
    return runs.select("experiment", "run_id", F.inline(every))


def append_run_log(long_runs: DataFrame, path: str) -> None:
    """Append-only log with one folder per experiment, so that a lookup reads one folder.

    Rebalancing by experiment keeps the number of files low and still splits a very large experiment.
    """
    long_runs.hint("rebalance", "experiment").write.mode("append").partitionBy("experiment").parquet(path)


def log_batch(rows: DataFrame, path: str, by: str, batch: str) -> None:
    """Append one batch of a log, in folders by a column and the batch. A repeated batch takes the place of its own rows and of no others.

    Folders of the batch are swapped when the job commits, so a reader finds the old rows or the new ones. A batch is repeated
    whole: a folder it no longer fills would keep what it had. A lookup by the column reads its folders only; a large one is split.
    """
    marked = rows.withColumn("batch", F.lit(batch))
    marked.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch").parquet(path)


def run_log_maps(long_runs: DataFrame) -> DataFrame:
    """The long table back to one row per run. Of a key that was logged more than once the last value stands.

    Last means the largest ``logged_at`` where there is such a column, and the largest value otherwise. Entries are reduced to
    one per key before they are gathered, so a map is as small as the number of its keys.
    """
    order = F.struct(*[c for c in ("logged_at", "value", "metric_value") if c in long_runs.columns])
    last = F.max_by(F.struct("value", "metric_value"), order).alias("last")
    long_runs = long_runs.groupBy("experiment", "run_id", "kind", "key").agg(last).select("experiment", "run_id", "kind", "key", "last.*")

    def entries(kind: str, value: str):
        pair = F.when(F.col("kind") == kind, F.struct("key", value))
        return F.map_from_entries(F.sort_array(F.collect_list(pair)))

    return long_runs.groupBy("experiment", "run_id").agg(
        entries("tag", "value").alias("tags"),
        entries("param", "value").alias("params"),
        entries("metric", "metric_value").alias("metrics"),
    )


def json_report(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One JSON object per row with its fields in alphabetical order."""
    return df.select(*keys, F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}).alias("report"))


def write_json_report(reports: DataFrame, path: str, indent: int | None = None) -> None:
    """One report per line; indented reports span lines."""
    text = F.col("report") if indent is None else canonical_json(F.col("report"), indent=indent)
    reports.select(text.alias("report")).write.mode("errorifexists").text(path)


def contract_report(tables: Mapping[str, DataFrame], contract: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Expected against actual column types of each table, with the nulls found in each column."""
    reports = []
    for name, expected in contract.items():
        df = tables[name]
        actual = dict(df.dtypes)
        rows = F.array(
            *[
                F.struct(
                    F.lit(name).alias("table_name"),
                    F.lit(column).alias("column_name"),
                    F.lit(data_type).alias("expected"),
                    F.lit(actual.get(column)).cast("string").alias("actual"),
                    (F.count_if(F.col(column).isNull()) if column in actual else F.lit(None).cast("bigint")).alias("nulls"),
                )
                for column, data_type in expected.items()
            ]
        )
        reports.append(df.agg(rows.alias("r")).select(F.inline("r")))
    every = reduce(DataFrame.unionByName, reports)
    return every.withColumn("ok", F.col("actual").eqNullSafe(F.col("expected")) & (F.col("nulls") == 0))
