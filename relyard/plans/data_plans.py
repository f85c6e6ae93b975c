"""Ingest, fingerprint, split, feature, training and evaluation queries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from relyard import constants as c
from relyard.functions.text import tag
from relyard.operators import evaluation, features, fingerprint, segment_training, split, training
from relyard.plans.catalog import query
from relyard.plans.oracle_views import sql
from relyard.session import new_location
from relyard.sources import tables, views
from relyard.sources.views import DATASET_FEATURES

ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# --- sources and sinks ------------------------------------------------------------------------------


@query("ingest_raw", sql("SELECT * FROM ds", "ds"))
def ingest_raw(spark: SparkSession, sf: str) -> DataFrame:
    return tables.write_raw(views.dataset(spark, sf), new_location(spark, "raw"), ["target", *DATASET_FEATURES])


@query("csv_roundtrip", sql("SELECT * FROM ds", "ds"))
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    data, path = views.dataset(spark, sf), new_location(spark, "csv")
    tables.write_csv(data, path)
    return tables.read_csv(spark, path, data.schema)


@query("dataset_shape", sql("SELECT count(*) AS rows, 5 AS cols FROM ds", "ds"))
def dataset_shape(spark: SparkSession, sf: str) -> DataFrame:
    return tables.shape(views.dataset(spark, sf))


_RUN_LOG_SQL = """
SELECT experiment, run_id, kind, t.key, CASE WHEN kind <> 'metric' THEN t.value END AS value,
  CASE WHEN kind = 'metric' THEN eval_roc_auc END AS metric_value
FROM (SELECT experiment, run_id, eval_roc_auc, 'tag' AS kind, unnest([
    {'key': 'step', 'value': step}, {'key': 'model_name', 'value': model_name}, {'key': 'git_sha', 'value': tag_git_sha},
    {'key': 'dataset_fingerprint', 'value': tag_dataset_fingerprint}, {'key': 'row_count', 'value': tag_row_count},
    {'key': 'training_run_id', 'value': tag_training_run_id}]) AS t FROM rn
  UNION ALL SELECT experiment, run_id, eval_roc_auc, 'param', unnest([
    {'key': 'class_weight', 'value': p_class_weight}, {'key': 'max_iter', 'value': p_max_iter}, {'key': 'model_type', 'value': 'logreg'},
    {'key': 'random_state', 'value': '42'}, {'key': 'solver', 'value': 'lbfgs'}]) FROM rn
  UNION ALL SELECT experiment, run_id, eval_roc_auc, 'metric', {'key': 'eval_roc_auc', 'value': NULL} FROM rn)"""


@query("run_log_long", sql(_RUN_LOG_SQL, "rn"))
def run_log_long(spark: SparkSession, sf: str) -> DataFrame:
    path = new_location(spark, "run-log")
    long_runs = tables.run_log_long(views.runs(spark, sf))
    tables.append_run_log(long_runs, path)
    stored = spark.read.schema(long_runs.schema).parquet(path)
    return stored


@query("run_log_repeated", sql(_RUN_LOG_SQL, "rn"))
def run_log_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Two jobs write the log and one of them runs again: every row is there once."""
    path = new_location(spark, "run-log")
    runs = views.runs(spark, sf)
    for job in ("train", "evaluate", "train"):
        tables.log_batch(tables.run_log_long(runs.where(F.col("step") == job)), path, "experiment", job)
    schema = tables.run_log_long(runs).schema
    return spark.read.schema(StructType([*schema.fields, StructField("batch", StringType())])).parquet(path).drop("batch")


@query(
    "run_log_maps",
    sql(
        """SELECT experiment, run_id, 6 AS n_tags, 5 AS n_params, tag_training_run_id AS training_run_id, p_max_iter AS max_iter,
        eval_roc_auc FROM rn""",
        "rn",
    ),
)
def run_log_maps(spark: SparkSession, sf: str) -> DataFrame:
    """A metric that was logged earlier with another value is among the rows."""
    long_runs = tables.run_log_long(views.runs(spark, sf)).withColumn("logged_at", F.lit(2))
    early = long_runs.filter("kind = 'metric'").withColumns({"logged_at": F.lit(1), "metric_value": F.col("metric_value") + 1})
    maps = tables.run_log_maps(long_runs.unionByName(early))
    return maps.select(
        "experiment",
        "run_id",
        F.size("tags").alias("n_tags"),
        F.size("params").alias("n_params"),
        F.col("tags")["training_run_id"].alias("training_run_id"),
        F.col("params")["max_iter"].alias("max_iter"),
        F.col("metrics")["eval_roc_auc"].alias("eval_roc_auc"),
    )


CONTRACT = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz"},
    "customer": {"c_custkey": "bigint", "c_acctbal": "double", "c_mktsegment": "string", "c_nationkey": "int"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "props": "string", "value": "double"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linestatus": "string", "l_shipdate": "timestamp"},
    "labels": {"doc_id": "bigint", "quality": "int", "target": "int"},
}
_SPARK_TYPE_SQL = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END"""
_KNOWN_COLUMNS = {"labels": ("doc_id", "quality")}


def _contract_sql() -> str:
    wanted = ", ".join(f"('{t}', '{c_}', '{k}')" for t, columns in CONTRACT.items() for c_, k in columns.items())
    nulls = " UNION ALL ".join(
        f"SELECT '{t}' AS t, '{c_}' AS c, count(*) - count({c_}) AS nulls FROM {t}"
        for t, columns in CONTRACT.items()
        for c_ in _KNOWN_COLUMNS.get(t, columns)
    )
    return f"""SELECT w.t AS table_name, w.c AS column_name, w.k AS expected, i.k AS actual, nulls, coalesce(i.k = w.k AND nulls = 0, false) AS ok
    FROM (VALUES {wanted}) w(t, c, k) LEFT JOIN ({nulls}) n ON n.t = w.t AND n.c = w.c
    LEFT JOIN (SELECT DISTINCT table_name AS t, column_name AS c, {_SPARK_TYPE_SQL} AS k FROM information_schema.columns) i ON i.t = w.t AND i.c = w.c"""


@query("schema_contract_check", _contract_sql())
def schema_contract_check(spark: SparkSession, sf: str) -> DataFrame:
    """One wrong type and one absent column are among the expectations, to be reported."""
    return tables.contract_report({name: tables.table(spark, sf, name) for name in CONTRACT}, CONTRACT)


# --- projection and casts ---------------------------------------------------------------------------


@query(
    "feature_label_split",
    sql("SELECT 'features' AS part, count(*) AS rows, 4 AS cols FROM ds UNION ALL SELECT 'label', count(*), 1 FROM ds", "ds"),
)
def feature_label_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = features.feature_label_split(views.dataset(spark, sf), "target")
    shapes = [tables.shape(df).select(F.lit(name).alias("part"), "rows", "cols") for name, df in zip(("features", "label"), parts)]
    return shapes[0].unionByName(shapes[1])


@query(
    "label_cast",
    "SELECT o_orderkey, CAST(trunc(o_totalprice / 1e5 - 2) AS INTEGER) AS target FROM orders",
)
def label_cast(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("o_totalprice") / F.lit(1e5) - 2
    return views.orders(spark, sf).select("o_orderkey", features.label_cast(label).alias("target"))


@query(
    "signature_example",
    sql("SELECT row_id, f0, f1, f2, 'row_id:int64,f0:float64,f1:float64,f2:float64' AS signature FROM ds ORDER BY row_id LIMIT 5", "ds"),
)
def signature_example(spark: SparkSession, sf: str) -> DataFrame:
    """Column types with a five-row example: the first rows by key, not whichever come first."""
    inputs = views.dataset(spark, sf).drop("target")
    signature = ",".join(f"{name}:{fingerprint.hash_type(t)}" for name, t in inputs.dtypes)
    return inputs.orderBy("row_id").limit(5).withColumn("signature", F.lit(signature))


# --- fingerprints -----------------------------------------------------------------------------------

_HASH_TYPE_SQL = """CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'float64'
  WHEN 'FLOAT' THEN 'float32' WHEN 'TIMESTAMP' THEN 'datetime64[us]' ELSE 'object' END"""


@query(
    "schema_hash",
    f"""SELECT table_name, n_columns, row_count, schema_hash FROM (
      SELECT table_name, count(*) AS n_columns, sha256(concat('[', string_agg(concat('["', column_name, '","', {_HASH_TYPE_SQL}, '"]'), ',' ORDER BY pos), ']')) AS schema_hash
      FROM (SELECT DISTINCT table_name, column_name, data_type, ordinal_position AS pos FROM information_schema.columns) GROUP BY table_name)
    JOIN ({' UNION ALL '.join(f"SELECT '{t}' AS t, count(*) AS row_count FROM {t}" for t in ALL_TABLES)}) ON t = table_name""",
)
def schema_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Schema hash of every table, next to its row count."""
    known = {name: tables.table(spark, sf, name) for name in ALL_TABLES}
    hashes = fingerprint.schema_hash(fingerprint.schema_columns(spark, known))
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name)) for name, df in known.items()]
    return hashes.join(reduce(DataFrame.unionByName, counts), "table_name").select("table_name", "n_columns", "row_count", "schema_hash")


# DuckDB side of the canonical row text: sorted columns f0, f1, f2, row_id, target.
_ROW_TEXT = "concat_ws(chr(31), concat('=', f0::VARCHAR), concat('=', f1::VARCHAR), concat('=', f2::VARCHAR), concat('=', row_id), concat('=', target))"


def _sums_sql() -> str:
    """Row count and the thirteen limb sums of digest h, joined as the final hash expects."""
    pieces = [f"('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT" for i in range(4)]
    limbs = [limb for x in pieces for limb in (f"({x} >> 40)", f"(({x} >> 20) & 1048575)", f"({x} & 1048575)")]
    limbs.append("('0x' || substr(h, 61, 4))::BIGINT")
    return "count(*), '|', " + ", '|', ".join(f"sum({limb})" for limb in limbs)


def _digest_sql(source: str) -> str:
    """Content hash over a query that yields the row digest as column h."""
    return f"SELECT count(*) AS row_count, sha256(concat({_sums_sql()})) AS content_hash FROM ({source})"


_MULTISET_SQL = _digest_sql(f"SELECT sha256({_ROW_TEXT}) AS h FROM ds")


@query("content_hash_multiset", sql(_MULTISET_SQL, "ds"))
def content_hash_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.content_hash_multiset(views.dataset(spark, sf))


def _key_bins(key: str) -> list[Column]:
    return [F.shiftright(key, 24), F.shiftright(key, 12)]


@query(
    "content_hash_ordered",
    sql(_digest_sql(f"SELECT sha256(concat(row_number() OVER (ORDER BY row_id) - 1, ':', sha256({_ROW_TEXT}))) AS h FROM ds"), "ds"),
)
def content_hash_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.content_hash_ordered(views.dataset(spark, sf), ["row_id"], _key_bins("row_id"))


@query(
    "content_hash_keyed",
    sql(_digest_sql(f"SELECT sha256(concat(row_number() OVER (ORDER BY target, f0, sha256({_ROW_TEXT})) - 1, ':', sha256({_ROW_TEXT}))) AS h FROM ds"), "ds"),
)
def content_hash_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted by label, then price; rows that share both follow their digests. Deeper bins serve a label that many rows share."""
    bins = [F.col("target"), F.floor(F.col("f0") / 4096), F.floor(F.col("f0") / 16), F.col("f0")]
    return fingerprint.content_hash_ordered(views.dataset(spark, sf), ["target", "f0"], bins)


@query(
    "content_hash_daily",
    f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS row_count, sha256(concat({_sums_sql()})) AS content_hash
    FROM (SELECT o_orderdate, sha256(concat_ws(chr(31), concat('=', o_custkey), concat('=', o_orderdate::VARCHAR), concat('=', o_orderkey),
      concat('=', o_orderpriority), concat('=', o_orderstatus), concat('=', o_totalprice::VARCHAR))) AS h FROM orders) GROUP BY 1""",
)
def content_hash_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Hash per month from daily partial states: states of append-only parts just add up."""
    orders = views.orders(spark, sf)
    daily = fingerprint.content_sums(
        orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")), ["day"], orders.columns
    )
    monthly = fingerprint.combine_sums(daily.withColumn("month", F.substring("day", 1, 7)), ["month"])
    return monthly.select("month", "row_count", fingerprint.finish_digest().alias("content_hash"))


@query(
    "content_hash_instants",
    f"""SELECT event_type, count(*) AS row_count, sha256(concat({_sums_sql()})) AS content_hash
    FROM (SELECT event_type, sha256(concat_ws(chr(31), concat('=', event_id), concat('=', epoch_us(ts)))) AS h FROM events) GROUP BY 1""",
)
def content_hash_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of a table with instants: they count as microseconds, so every session time zone gives the same hash."""
    instant = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp").alias("ts")
    events = tables.table(spark, sf, "events").select("event_type", "event_id", instant)
    return fingerprint.content_hash_multiset(events, ["event_type"])


URI = "file:///data/table"
_DS_SCHEMA = '[["row_id","int64"],["target","int32"],["f0","float64"],["f1","float64"],["f2","float64"]]'
_FINGERPRINT_SQL = f"""SELECT 'dataset_fingerprint/v1' AS schema_version, 'unknown' AS git_sha, content_hash AS dataset_content_hash,
 sha256('{_DS_SCHEMA}') AS dataset_schema_hash, row_count, '{URI}' AS data_source_uri FROM ({_MULTISET_SQL})"""


def _fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.dataset_fingerprint(_split(spark, sf), "split", URI, None)


@query("dataset_fingerprint", sql(_FINGERPRINT_SQL, "ds"))
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprint(spark, sf)


@query(
    "fingerprint_tags",
    sql(
        f"""SELECT t.key, t.value FROM (SELECT unnest([{{'key': 'git_sha', 'value': git_sha}}, {{'key': 'dataset_content_hash', 'value': dataset_content_hash}},
        {{'key': 'dataset_schema_hash', 'value': dataset_schema_hash}}, {{'key': 'row_count', 'value': CAST(row_count AS VARCHAR)}},
        {{'key': 'data_source_uri', 'value': data_source_uri}}]) AS t FROM ({_FINGERPRINT_SQL}))""",
        "ds",
    ),
)
def fingerprint_tags(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.fingerprint_tags(_fingerprint(spark, sf))


@query(
    "fingerprint_tag",
    sql(
        f"""SELECT sha256(concat('{{', chr(10), '  "data_source_uri": "', data_source_uri, '",', chr(10), '  "dataset_content_hash": "', dataset_content_hash, '",', chr(10),
        '  "dataset_schema_hash": "', dataset_schema_hash, '",', chr(10), '  "git_sha": "', git_sha, '",', chr(10), '  "row_count": ', row_count, ',', chr(10),
        '  "schema_version": "', schema_version, '"', chr(10), '}}')) AS dataset_fingerprint FROM ({_FINGERPRINT_SQL})""",
        "ds",
    ),
)
def fingerprint_tag(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.fingerprint_tag(_fingerprint(spark, sf))


@query(
    "config_hash",
    sql(
        """SELECT run_id, sha256(concat('{"C":0.5,"class_weight":', CASE WHEN p_class_weight IS NULL THEN 'null' ELSE '"balanced"' END,
        ',"fit_intercept":true,"max_iter":', p_max_iter, ',"model_type":"logreg","note":"say \\"', model_name,
        '\\"\\n\\u00e9","random_state":42,"solver":"lbfgs"}')) AS config_hash FROM rn""",
        "rn",
    ),
)
def config_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded params with a float, a flag and a note that needs escaping."""
    note = F.concat(F.lit('say "'), F.col("model_name"), F.lit('"\né'))
    more = F.create_map(F.lit("C"), F.lit("0.5"), F.lit("fit_intercept"), F.lit("true"), F.lit("note"), note)
    params = views.runs(spark, sf).select("run_id", F.explode(F.map_concat("params", more)).alias("key", "value"))
    kind = F.when(F.col("key").isin("C", "max_iter", "random_state"), "number").when(F.col("key") == "fit_intercept", "bool").otherwise("text")
    return fingerprint.config_hash(params.withColumn("value_type", kind))


@query(
    "git_sha_default",
    sql("SELECT run_id, coalesce(nullif(trim(tag_git_sha), ''), tag_dataset_fingerprint, 'unknown') AS git_sha FROM rn", "rn"),
)
def git_sha_default(spark: SparkSession, sf: str) -> DataFrame:
    """First usable of two recorded places, else 'unknown'."""
    tags = F.col("tags")
    sha = fingerprint.default_git_sha(tag(tags, "git_sha"), tag(tags, "dataset_fingerprint"))
    return views.runs(spark, sf).select("run_id", sha.alias("git_sha"))


# Stored contract documents, one per order: which contract and which defect depends on the key.
_DOCUMENT = """CASE o_orderkey % 12
 WHEN 0 THEN concat('{"schema_version": "dataset_fingerprint/v1", "git_sha": "s", "dataset_content_hash": "c", "dataset_schema_hash": "h", "row_count": ', o_custkey, ', "data_source_uri": "u"}')
 WHEN 1 THEN '{"schema_version": "dataset_fingerprint/v0", "git_sha": "s"}'
 WHEN 2 THEN '{"schema_version": "dataset_fingerprint/v1", "git_sha": "s", "dataset_content_hash": "c"}'
 WHEN 3 THEN concat('{"schema_version": "model_ref/v1", "model_name": "m', o_custkey, '", "alias": "", "version": "', o_orderkey, '"}')
 WHEN 4 THEN concat('{"schema_version": "model_ref/v1", "model_name": "m', o_custkey, '", "alias": "prod", "source_run_id": "run-', o_orderkey, '"}')
 WHEN 5 THEN '{"schema_version": "model_ref/v1", "alias": "prod"}'
 WHEN 6 THEN concat('{"schema_version": "feature_stats/v1", "stats": {"f0": {"mean": ', o_custkey, '}}}')
 WHEN 7 THEN '{"schema_version": "feature_stats/v1", "stats": [1, 2]}'
 WHEN 8 THEN '{"schema_version": "feature_stats/v1"}'
 WHEN 9 THEN '{"schema_version": '
 WHEN 10 THEN '{"schema_version": "dataset_fingerprint/v1", "git_sha": "s", "dataset_content_hash": "c", "dataset_schema_hash": "h", "row_count": "many", "data_source_uri": "u"}'
 ELSE '{"model_name": "m"}' END"""
_EXPECTED = """CASE WHEN o_orderkey % 12 IN (0, 1, 2, 9, 10) THEN 'dataset_fingerprint/v1' WHEN o_orderkey % 12 IN (3, 4, 5, 11) THEN 'model_ref/v1'
 ELSE 'feature_stats/v1' END"""


@query(
    "contract_validation",
    """SELECT o_orderkey, CASE o_orderkey % 12 WHEN 1 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN 2 THEN 'MISSING_KEY dataset_schema_hash' WHEN 5 THEN 'MISSING_KEY model_name'
      WHEN 7 THEN 'STATS_NOT_A_DICT' WHEN 8 THEN 'STATS_NOT_A_DICT' WHEN 9 THEN 'INVALID_JSON' WHEN 10 THEN 'ROW_COUNT_NOT_A_NUMBER' WHEN 11 THEN 'UNSUPPORTED_SCHEMA_VERSION' END AS error,
    CASE WHEN o_orderkey % 12 IN (4, 5) THEN 'prod' END AS ref_alias, CASE WHEN o_orderkey % 12 = 3 THEN CAST(o_orderkey AS VARCHAR) END AS ref_version,
    CASE WHEN o_orderkey % 12 = 4 THEN concat('run-', o_orderkey) END AS ref_source_run_id FROM orders""",
)
def contract_validation(spark: SparkSession, sf: str) -> DataFrame:
    documents = views.orders(spark, sf).select("o_orderkey", F.expr(_DOCUMENT).alias("document"), F.expr(_EXPECTED).alias("wanted"))
    checked = fingerprint.validate_contracts(documents, F.col("wanted"))
    return checked.drop("document", "wanted")


# --- split and features -----------------------------------------------------------------------------


def _split(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_split(views.dataset(spark, sf), "target", "row_id")


@query("stratified_split", sql("SELECT row_id, target, split FROM sp", "sp"))
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("row_id", "target", "split")


@query("split_balance", sql("SELECT split, target, count(*) AS n FROM sp GROUP BY ALL", "sp"))
def split_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per side and class, read back from the stored, split-partitioned table."""
    return _stored_split(spark, sf).groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).filter(F.col("split") == "train")


def _stored_split(spark: SparkSession, sf: str) -> DataFrame:
    """The split written once, for work that reads it several times."""
    parts, path = _split(spark, sf), new_location(spark, "split")
    split.write_split(parts, path)
    return spark.read.schema(parts.schema).parquet(path)


_FIT_SQL = "SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in DATASET_FEATURES) + " FROM sp WHERE split = 'train'"


@query(
    "scaler_fit",
    sql(
        "SELECT feature, round(m, 6) AS mean, round(s, 6) AS std FROM ("
        + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg({f}) AS m, stddev_pop({f}) AS s FROM sp WHERE split = 'train'" for f in DATASET_FEATURES)
        + ")",
        "sp",
    ),
)
def scaler_fit(spark: SparkSession, sf: str) -> DataFrame:
    fitted = features.fit_scaler(_train(spark, sf), DATASET_FEATURES)
    return fitted.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "scaler_apply",
    sql(
        "SELECT row_id, split, " + ", ".join(f"round(({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END, 6) AS {f}" for f in DATASET_FEATURES)
        + f" FROM sp, ({_FIT_SQL})",
        "sp",
    ),
)
def scaler_apply(spark: SparkSession, sf: str) -> DataFrame:
    both = _stored_split(spark, sf)
    fitted = features.fit_scaler(both.filter(F.col("split") == "train"), DATASET_FEATURES)
    scaled = features.apply_scaler(both, fitted, DATASET_FEATURES)
    return scaled.select("row_id", "split", *[F.round(f, 6).alias(f) for f in DATASET_FEATURES])


@query(
    "class_weights",
    sql("SELECT target, count(*) AS n_class, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM sp WHERE split = 'train' GROUP BY target", "sp"),
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return features.class_weights(_train(spark, sf), "target").withColumn("weight", F.round("weight", 9))


def _stats_sql(where: str, prefix: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT {prefix}'{f}' AS feature, count({f}) AS count, count(*) - count({f}) AS nulls, round(avg({f}), 6) AS mean,
        round(stddev_pop({f}), 6) AS std, min({f}) AS min, max({f}) AS max FROM {where}"""
        for f in DATASET_FEATURES
    )


@query("feature_stats", sql(_stats_sql("ds"), "ds"))
def feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_stats(views.dataset(spark, sf), [], DATASET_FEATURES)


@query(
    "feature_stats_json",
    sql(
        "SELECT 'feature_stats/v1' AS schema_version, feature, " + ", ".join(f"CAST({v} AS DOUBLE) AS {v}" for v in ("count", "max", "mean", "min", "nulls", "std"))
        + " FROM (" + _stats_sql("ds") + ")", "ds"
    ),
)
def feature_stats_json(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics contract written as JSON and read back, value by value."""
    stats = features.feature_stats(views.dataset(spark, sf), [], DATASET_FEATURES)
    document = features.feature_stats_json(stats, c.FEATURE_STATS_VERSION)
    parsed = F.from_json("document", "schema_version string, stats map<string, map<string, double>>")
    read = document.select(parsed.alias("d")).select("d.schema_version", F.explode("d.stats").alias("feature", "s"))
    return read.select("schema_version", "feature", *[F.col("s")[v].alias(v) for v in ("count", "max", "mean", "min", "nulls", "std")])


@query("feature_quantiles")
def feature_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_quantiles(views.dataset(spark, sf), [], DATASET_FEATURES, (0.25, 0.5, 0.75))


def _psi_sql() -> str:
    parts = []
    for f in DATASET_FEATURES:
        parts.append(
            f"""SELECT '{f}' AS feature, round(sum((p - q) * ln(p / q)), 6) AS psi FROM (
            SELECT greatest(l / sum(l) OVER (), 1e-6) AS p, greatest(r / sum(r) OVER (), 1e-6) AS q FROM (
              SELECT least(9, CAST(floor(({f} - lo) / ((hi - lo) / 10)) AS INTEGER)) AS b, count(*) FILTER (split = 'train') AS l, count(*) FILTER (split = 'test') AS r
              FROM sp, (SELECT min({f}) AS lo, max({f}) AS hi FROM sp) GROUP BY 1))"""
        )
    return " UNION ALL ".join(parts)


@query(
    "feature_drift",
    sql(
        "SELECT t.feature, "
        + ", ".join(f"t.{s} AS train_{s}" for s in ("count", "mean", "std", "min", "max")) + ", "
        + ", ".join(f"u.{s} AS test_{s}" for s in ("count", "mean", "std", "min", "max"))
        + f", psi FROM ({_stats_sql('''(SELECT * FROM sp WHERE split = 'train')''')}) t JOIN ({_stats_sql('''(SELECT * FROM sp WHERE split = 'test')''')}) u"
        + f" ON t.feature = u.feature JOIN ({_psi_sql()}) i ON i.feature = t.feature",
        "sp",
    ),
)
def feature_drift(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_drift(_stored_split(spark, sf), "split", "train", "test", DATASET_FEATURES)


# --- training ---------------------------------------------------------------------------------------


@query("train_logreg")
def train_logreg(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced logistic regression on all embedding dimensions; the positive class is a label below 3."""
    embeddings = tables.table(spark, sf, "embeddings")
    width = embeddings.agg(F.max(F.size("embedding"))).first()[0]
    # A shorter vector counts as zero in the dimensions it lacks.
    dimensions = [F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0)).alias(f"e{i}") for i in range(width)]
    rows = embeddings.select(F.when(F.col("label") < 3, F.lit(1)).otherwise(F.lit(0)).alias("target"), *dimensions)
    return training.train_logreg(rows, [f"e{i}" for i in range(width)], "target")


@query("train_evaluate")
def train_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """Split, train, score the held-out rows with the coefficients as data, evaluate and gate.

    The split is stored first, as every later step reads it again.
    """
    both = _stored_split(spark, sf)
    train = both.filter(F.col("split") == "train")
    model = training.train_logreg(train, DATASET_FEATURES, "target")
    terms = F.struct(
        F.first("intercept").alias("intercept"), F.collect_list(F.struct("feature", "mean", "std", "coef")).alias("terms")
    )
    fitted = model.agg(terms.alias("m")).scalar()
    test = both.filter(F.col("split") == "test").withColumn("m", fitted)
    scored = training.score_columns(test, F.col("m"), DATASET_FEATURES).select(
        F.lit("candidate").alias("model_name"), F.col("target").alias("label"), "score"
    )
    return evaluation.report(scored, ["model_name"], "test_")


@query("train_per_segment")
def train_per_segment(spark: SparkSession, sf: str) -> DataFrame:
    return training.train_per_segment(views.owned_dataset(spark, sf), "segment", DATASET_FEATURES, "target")


def _gradient(rows: DataFrame, group: list[str], label: str, scaled: dict[str, Column], coefs: dict[str, Column], intercept: Column, weight: Column) -> DataFrame:
    """Largest entry per group of the gradient of the penalised loss, per row: zero at the optimum."""
    z = intercept + reduce(lambda a, b: a + b, [coefs[f] * scaled[f] for f in scaled])
    rest = weight * (1 / (1 + F.exp(-z)) - F.col(label))
    slopes = [F.abs(F.sum(rest * scaled[f]) + F.first(coefs[f])) for f in scaled]
    worst = F.greatest(F.abs(F.sum(rest)), *slopes) / F.count(F.lit(1))
    return rows.groupBy(*group).agg(worst.alias("gradient"))


@query("train_optimum", "SELECT true AS at_optimum")
def train_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The regression's gradient, summed over all rows again with the coefficients it returned, is zero."""
    rows = views.dataset(spark, sf)
    model = {r["feature"]: r for r in training.train_logreg(rows, DATASET_FEATURES, "target").collect()}
    balance = {r["target"]: r["weight"] for r in features.class_weights(rows, "target").collect()}
    scaled = {f: (F.col(f) - m["mean"]) / (m["std"] or 1.0) for f, m in model.items()}
    weight = F.when(F.col("target") == 1, balance[1]).otherwise(balance[0])
    coefs = {f: F.lit(m["coef"]) for f, m in model.items()}
    found = _gradient(rows, [], "target", scaled, coefs, F.lit(model["f0"]["intercept"]), weight)
    return found.select((F.col("gradient") < 1e-5).alias("at_optimum"))


@query("segment_optimum", "SELECT DISTINCT c_mktsegment AS segment, true AS converged, true AS at_optimum FROM customer JOIN orders ON c_custkey = o_custkey")
def segment_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The same for each segment's own regression."""
    rows = views.owned_dataset(spark, sf)
    fitted = training.train_per_segment(rows, "segment", DATASET_FEATURES, "target")
    moments = [x for f in DATASET_FEATURES for x in (F.avg(f).alias(f"mean_{f}"), F.stddev_pop(f).alias(f"std_{f}"))]
    known = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("n1"), *moments)
    joined = rows.join(F.broadcast(known.join(fitted, "segment")), "segment")  # one row per market segment
    scaled = {f: (F.col(f) - F.col(f"mean_{f}")) / F.when(F.col(f"std_{f}") == 0, 1.0).otherwise(F.col(f"std_{f}")) for f in DATASET_FEATURES}
    weight = F.col("n") / (2.0 * F.when(F.col("target") == 1, F.col("n1")).otherwise(F.col("n") - F.col("n1")))
    coefs = {f: F.col(f"coef_{f}") for f in DATASET_FEATURES}
    found = _gradient(joined, ["segment", "converged"], "target", scaled, coefs, F.col("intercept"), weight)
    return found.select("segment", "converged", (F.col("gradient") < 1e-7).alias("at_optimum"))


@query(
    "model_training_optimum",
    sql(
        """SELECT concat('m', o_custkey) AS model_name, CASE WHEN min(ds.target) = max(ds.target) THEN 'one class' END AS reason,
          min(ds.target) <> max(ds.target) AS converged, CASE WHEN min(ds.target) <> max(ds.target) THEN true END AS at_optimum
        FROM ds JOIN orders ON o_orderkey = row_id GROUP BY o_custkey""",
        "ds",
    ),
)
def model_training_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """A regression per model, thousands at once; where one was fitted its gradient, summed over the rows again, is zero."""
    rows = views.owned_dataset(spark, sf)
    fitted = segment_training.train_segments(rows, "model_name", DATASET_FEATURES, "target")
    moments = [x for f in DATASET_FEATURES for x in (F.avg(f).alias(f"mean_{f}"), F.stddev_pop(f).alias(f"std_{f}"))]
    known = rows.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("n1"), *moments)
    joined = rows.join(known, "model_name").join(fitted.select("model_name", "intercept", "coefs", "converged", "reason"), "model_name")
    scaled = {f: (F.col(f) - F.col(f"mean_{f}")) / F.when(F.col(f"std_{f}") == 0, 1.0).otherwise(F.col(f"std_{f}")) for f in DATASET_FEATURES}
    weight = F.col("n") / (2.0 * F.when(F.col("target") == 1, F.col("n1")).otherwise(F.col("n") - F.col("n1")))
    coefs = {f: F.col("coefs")[i] for i, f in enumerate(DATASET_FEATURES)}
    found = _gradient(joined, ["model_name", "converged", "reason"], "target", scaled, coefs, F.col("intercept"), weight)
    return found.select("model_name", "reason", "converged", F.when(F.col("converged"), F.col("gradient") < 1e-7).alias("at_optimum"))


@query("feature_quantile_ranks", " UNION ALL ".join(f"SELECT '{f}' AS feature, {q} AS quantile, true AS within_bound" for f in DATASET_FEATURES for q in ("0.25e0", "0.5e0", "0.75e0")))
def feature_quantile_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Each approximate quantile lies among values whose exact rank is off by at most a thousandth of the rows."""
    rows, points = views.dataset(spark, sf), (0.25, 0.5, 0.75)
    found = {r["feature"]: r for r in features.feature_quantiles(rows, [], DATASET_FEATURES, points).collect()}
    checks = [
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(q).alias("quantile"),
            ((F.avg((F.col(f) < value).cast("double")) <= q + 1e-3) & (F.avg((F.col(f) <= value).cast("double")) >= q - 1e-3)).alias("within_bound"),
        )
        for f in DATASET_FEATURES
        for q, value in zip(points, found[f]["quantiles"])
    ]
    return rows.agg(F.array(*checks).alias("c")).select(F.inline("c"))


@query(
    "score_pandas_udf",
    sql("SELECT row_id, round(1 / (1 + exp(-(f0 / 5e5 - f1 / 1e4 + f2 / 25e0))), 6) AS proba FROM ds", "ds"),
)
def score_pandas_udf(spark: SparkSession, sf: str) -> DataFrame:
    """Any object with ``predict`` scores the dataset in Arrow batches."""

    class Linear:
        def predict(self, df: pd.DataFrame) -> list[float]:
            import numpy as np

            z = df["f0"] / 5e5 - df["f1"] / 1e4 + df["f2"] / 25
            return list(1 / (1 + np.exp(-z)))

    score = training.predictor_udf(Linear())
    return views.dataset(spark, sf).select("row_id", F.round(score(F.struct(*DATASET_FEATURES)), 6).alias("proba"))


# --- evaluation -------------------------------------------------------------------------------------

_CONFUSION = """SELECT {group}, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp,
 count(*) FILTER (score < 0.5 AND label <> 1) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn,
 count(*) FILTER (score IS NULL OR label IS NULL) AS invalid FROM {source} GROUP BY {group}"""
_AUC = """SELECT {group}, sum(pos) AS positives, sum(neg) AS negatives, sum(bad) AS invalid,
 CASE WHEN sum(pos) > 0 AND sum(neg) > 0 AND sum(bad) = 0 THEN sum(pos * (below + neg / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc
 FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {group} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
   FROM (SELECT {group}, score, count(*) FILTER (label = 1 AND score IS NOT NULL) AS pos, count(*) FILTER (label <> 1 AND score IS NOT NULL) AS neg,
     count(*) FILTER (label IS NULL OR score IS NULL) AS bad FROM {source} GROUP BY {group}, score))
 GROUP BY {group}"""


@query("confusion_counts", sql(_CONFUSION.format(group="model_name, slice", source="sb"), "sb"))
def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion(views.scores_big(spark, sf), ["model_name", "slice"])


@query(
    "accuracy",
    sql(f"SELECT model_name, CASE WHEN invalid = 0 THEN round((tp + tn) / (tp + fp + tn + fn), 6) END AS accuracy FROM ({_CONFUSION.format(group='model_name', source='sb')})", "sb"),
)
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    counts = evaluation.confusion(views.scores_big(spark, sf), ["model_name"])
    return counts.select("model_name", F.round(evaluation.accuracy_of(), 6).alias("accuracy"))


@query(
    "f1",
    sql(
        f"SELECT slice, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM ({_CONFUSION.format(group='slice', source='sc')})",
        "sc",
    ),
)
def f1(spark: SparkSession, sf: str) -> DataFrame:
    counts = evaluation.confusion(views.scores(spark, sf), ["slice"])
    return counts.select("slice", F.round(evaluation.f1_of(), 6).alias("f1"))


def _auc_sql(group: str, source: str) -> str:
    return (
        f"SELECT {group}, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, CAST(invalid AS BIGINT) AS invalid, round(auc, 9) AS auc "
        f"FROM ({_AUC.format(group=group, source=source)})"
    )


@query("roc_auc", sql(_auc_sql("model_name", "sb"), "sb"))
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.roc_auc(views.scores_big(spark, sf), ["model_name"]).withColumn("auc", F.round("auc", 9))


@query("roc_auc_by_slice", sql(_auc_sql("slice", "sc"), "sc"))
def roc_auc_by_slice(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.roc_auc(views.scores(spark, sf), ["slice"]).withColumn("auc", F.round("auc", 9))


@query(
    "auc_hard_label",
    sql(
        _auc_sql("slice", "(SELECT slice, label, CASE WHEN score >= 0.5 THEN 1e0 ELSE 0e0 END AS score FROM sb WHERE score IS NOT NULL AND label IS NOT NULL)"), "sb"
    ),
)
def auc_hard_label(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of thresholded predictions, which is the balanced accuracy."""
    hard = evaluation.roc_auc(views.scores_big(spark, sf).filter(evaluation.usable()), ["slice"], "label")
    return hard.withColumn("auc", F.round("auc", 9))


@query(
    "roc_curve_points",
    sql(
        """SELECT slice, score AS threshold, round(sum(neg) OVER w / sum(neg) OVER g, 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER g, 6) AS tpr
        FROM (SELECT slice, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM sb
              WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY slice, score
              UNION ALL SELECT slice, CAST('inf' AS DOUBLE), 0, 0 FROM sb GROUP BY slice)
        WINDOW w AS (PARTITION BY slice ORDER BY score DESC), g AS (PARTITION BY slice)""",
        "sb",
    ),
)
def roc_curve_points(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.roc_points(views.scores_big(spark, sf), ["slice"])


@query(
    "roc_curve_corners",
    sql(
        """SELECT slice, threshold, round(fp / sum_neg, 6) AS fpr, round(tp / sum_pos, 6) AS tpr FROM (
          SELECT slice, score AS threshold, sum(neg) OVER w AS fp, sum(pos) OVER w AS tp, sum(neg) OVER g AS sum_neg, sum(pos) OVER g AS sum_pos,
            score = 'inf'::DOUBLE OR lead(pos) OVER w IS NULL OR pos * lead(neg) OVER w <> lead(pos) OVER w * neg AS turns
          FROM (SELECT slice, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM sb
                WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY slice, score
                UNION ALL SELECT slice, CAST('inf' AS DOUBLE), 0, 0 FROM sb GROUP BY slice)
          WINDOW w AS (PARTITION BY slice ORDER BY score DESC), g AS (PARTITION BY slice)) WHERE turns""",
        "sb",
    ),
)
def roc_curve_corners(spark: SparkSession, sf: str) -> DataFrame:
    """The curve as it is drawn: points on a line between their neighbours are left out."""
    return evaluation.roc_corners(views.scores_big(spark, sf), ["slice"])


_REPORT = """SELECT c.model_name, CASE WHEN c.invalid = 0 THEN round((tp + tn) / (tp + fp + tn + fn), 6) END AS {p}accuracy,
 CASE WHEN c.invalid = 0 THEN round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) END AS {p}f1, round(auc, 6) AS {p}roc_auc,
 CASE WHEN coalesce(auc >= 0.95, false) THEN 'true' ELSE 'false' END AS gate_ok
 FROM ({confusion}) c JOIN ({auc}) a ON a.model_name = c.model_name"""
_REPORT_SQL = _REPORT.format(
    p="eval_", confusion=_CONFUSION.format(group="model_name", source="sb"), auc=_AUC.format(group="model_name", source="sb")
)


@query("evaluation_report", sql(_REPORT_SQL, "sb"))
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.report(views.scores_big(spark, sf), ["model_name"])


@query(
    "eval_report_json",
    sql(
        f"""SELECT model_name, concat('{{"eval_accuracy":', coalesce(eval_accuracy::VARCHAR, 'null'), ',"eval_f1":', coalesce(eval_f1::VARCHAR, 'null'),
        ',"eval_roc_auc":', coalesce(eval_roc_auc::VARCHAR, 'null'), '}}') AS report FROM ({_REPORT_SQL})""",
        "sb",
    ),
)
def eval_report_json(spark: SparkSession, sf: str) -> DataFrame:
    reports = evaluation.report(views.scores_big(spark, sf), ["model_name"])
    return tables.json_report(reports, ["model_name"], ["eval_roc_auc", "eval_f1", "eval_accuracy"])


_HARD = "(SELECT model_name, label, CASE WHEN score >= 0.5 THEN 1e0 WHEN score < 0.5 THEN 0e0 END AS score FROM sb)"


@query(
    "metrics_pivot",
    sql(
        f"""SELECT model_name, eval_accuracy AS test_accuracy, eval_f1 AS test_f1, eval_roc_auc AS test_roc_auc, eval_accuracy, eval_f1, round(auc, 6) AS eval_roc_auc
        FROM ({_REPORT_SQL}) r JOIN ({_AUC.format(group='model_name', source=_HARD)}) h USING (model_name)""",
        "sb",
    ),
)
def metrics_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Both metric sets of a model side by side: test_* on probabilities, eval_* on 0/1 predictions."""
    scored, keys = views.scores_big(spark, sf), ["model_name"]
    sets = {"test_": "probability", "eval_": "label"}
    metrics = {prefix: [f"{prefix}{m}" for m in ("accuracy", "f1", "roc_auc")] for prefix in sets}
    long = [
        evaluation.metrics_long(evaluation.report(scored, keys, prefix, kind), keys, metrics[prefix])
        for prefix, kind in sets.items()
    ]
    return evaluation.metrics_pivot(long[0].unionByName(long[1]), keys, metrics["test_"] + metrics["eval_"])


@query(
    "quality_gate",
    sql("SELECT run_id, CASE WHEN eval_roc_auc >= 0.95 THEN 'true' ELSE 'false' END AS gate_ok FROM rn", "rn"),
)
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    auc = F.col("metrics")["eval_roc_auc"]
    return views.runs(spark, sf).select("run_id", evaluation.gate_text(auc).alias("gate_ok"))
