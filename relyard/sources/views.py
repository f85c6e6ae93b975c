"""Release tables derived from the given tables: registry, runs, requests, scores, dataset.

A customer stands for a model and each of its orders for one model version and one run; an event is a
served request. CASE expressions over keys give the rows variety (blank tags, retries, bad bodies);
every row of the base table is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relyard.operators.ordered import exact_rank, needed_bins
from relyard.sources.tables import table


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_name, version, source_run_id, tags, created_at, o_orderkey: one row per order."""
    # Only a customer with very many orders needs bins: by date, then by ranges of the order key.
    dated = orders(spark, sf_dir).selectExpr(
        "*", "shiftright(o_orderkey, 24) AS _coarse_key", "shiftright(o_orderkey, 12) AS _fine_key"
    )
    bins = needed_bins(dated, ["o_custkey"], ["o_orderdate", "_coarse_key", "_fine_key"])
    numbered = exact_rank(dated, ["o_custkey"], bins, ["o_orderdate", "o_orderkey"], "version")
    with_source = numbered.selectExpr(
        "*",
        # Versions of priority 4 name a run that never was.
        """CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN concat('lost-', o_orderkey)
                ELSE concat('run-', o_orderkey) END AS source_run_id""",
    )
    return with_source.selectExpr(
        "concat('m', o_custkey) AS model_name",
        "version",
        "source_run_id",
        """map('source_run_id', source_run_id,
               'dataset_fingerprint', CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('fp-', o_orderkey) END,
               'git_sha', CASE WHEN o_orderkey % 13 = 0 THEN '  ' ELSE concat('sha-', o_orderkey) END,
               'config_hash', CASE WHEN o_orderkey % 17 <> 0 THEN concat('cfg-', o_orderkey) END,
               'training_run_id', CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat('run-', o_orderkey) END,
               'gate', CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN ' passed ' ELSE 'failed' END,
               'release_status', CASE o_orderpriority WHEN '1-URGENT' THEN 'prod' WHEN '5-LOW' THEN '' ELSE 'candidate' END
        ) AS tags""",
        "o_orderdate AS created_at",
        "o_orderkey",
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model with its newest version number: versions count up from 1."""
    counted = orders(spark, sf_dir).groupBy("o_custkey").count()
    return counted.selectExpr("concat('m', o_custkey) AS model_name", "o_custkey", "count AS newest")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_name, alias, version. Account balance, segment and nation decide which aliases exist."""
    owner = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS o_custkey",
        "c_acctbal",
        "c_nationkey < 2 AS same",
        "c_nationkey >= 2 AND c_mktsegment <> 'HOUSEHOLD' AS behind",
    )
    return models(spark, sf_dir).join(owner, "o_custkey").selectExpr(
        "model_name",
        """inline(filter(array(
             CASE WHEN c_acctbal >= 500 THEN named_struct('alias', 'candidate', 'version', newest) END,
             CASE WHEN same THEN named_struct('alias', 'prod', 'version', newest)
                  WHEN behind AND newest > 1 THEN named_struct('alias', 'prod', 'version', newest - 1) END,
             CASE WHEN behind AND newest > 1 THEN named_struct('alias', 'champion',
                  'version', CASE WHEN c_acctbal > 9000 THEN 1L ELSE newest - 1 END) END), a -> a IS NOT NULL))""",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, experiment, model_name, step, start_time, tags, params, metrics, gate_ok: one run per order."""
    base = orders(spark, sf_dir).selectExpr(
        "*",
        "CASE WHEN o_orderpriority = '2-HIGH' THEN 'evaluate' ELSE 'train' END AS step",
        "o_totalprice / 5e5 AS eval_roc_auc",
    )
    return base.selectExpr(
        "concat('run-', o_orderkey) AS run_id",
        "concat('e', o_custkey % 20) AS experiment",
        "concat('m', o_custkey) AS model_name",
        "step",
        "o_orderdate AS start_time",
        """map('step', step,
               'model_name', concat('m', o_custkey),
               'git_sha', CASE WHEN o_orderkey % 13 = 0 THEN '  ' ELSE concat(' sha-', o_orderkey) END,
               'dataset_fingerprint', CASE WHEN o_orderkey % 11 <> 0 THEN concat('fp-', o_orderkey) END,
               'row_count', CAST(o_custkey AS STRING),
               'training_run_id', concat('run-', o_orderkey)) AS tags""",
        """map('class_weight', CASE WHEN o_orderstatus <> 'P' THEN 'balanced' END,
               'max_iter', CAST(1000 + (o_orderkey % 3) * 500 AS STRING),
               'model_type', 'logreg',
               'random_state', '42',
               'solver', 'lbfgs') AS params""",
        "map('eval_roc_auc', eval_roc_auc) AS metrics",
        """CASE WHEN eval_roc_auc < 0.95 THEN 'false' WHEN o_orderstatus = 'F' THEN 'true'
                WHEN o_orderstatus = 'O' THEN concat(' TRUE', char(10)) ELSE 'yes' END AS gate_ok""",
    )


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_name, version, model: a linear model per version, as data."""
    return model_versions(spark, sf_dir).selectExpr(
        "model_name",
        "version",
        """named_struct('intercept', (o_orderkey % 7 - 3) / 1e1, 'terms', array(
             named_struct('feature', 'k', 'mean', 50e0, 'std', 25e0, 'coef', (o_orderkey % 11 - 5) / 1e1),
             named_struct('feature', 'v', 'mean', 25e0, 'std', CASE WHEN o_orderkey % 10 = 0 THEN 0e0 ELSE 20e0 END,
                          'coef', (o_orderkey % 5 - 2) / 1e1))) AS model""",
    )


def requests_from(events: DataFrame) -> DataFrame:
    """The request log as columns over events; works on a batch table and on a stream."""
    parsed = events.selectExpr("*", "get_json_object(props, '$.k') AS k", "CAST(floor(value) AS BIGINT) AS v")
    return parsed.selectExpr(
        "event_id",
        "ts",
        "user_id",
        "concat('m', user_id) AS model_name",
        """CASE event_id % 3 WHEN 1 THEN concat(' req-', event_id % 4000, ' ')
                             WHEN 2 THEN concat('req-', event_id) END AS client_request_id""",
        """CASE user_id % 6 WHEN 0 THEN 'prod' WHEN 1 THEN 'candidate' WHEN 2 THEN 'shadow' WHEN 5 THEN 'bogus'
                            ELSE 'canary' END AS mode""",
        "CASE event_type WHEN 'view' THEN '/health' WHEN 'signup' THEN '/metrics' ELSE '/predict' END AS endpoint",
        """CASE event_id % 20
             WHEN 9 THEN props
             WHEN 19 THEN '{"rows": [{"k": 1'
             WHEN 13 THEN '{"rows": {"k": 1}}'
             WHEN 14 THEN '{"rows": []}'
             WHEN 7 THEN '{"rows": [{"k": 1, "v": 2}, 5]}'
             WHEN 3 THEN concat('{"rows": [{"k": ', k, '}]}')
             WHEN 4 THEN concat('{"rows": [{"v": ', v, '.0, "k": ', k, '.50, "é": 0.00001}, {"k": ', k, '.5, "v": ', event_id % 50, '.0}]}')
             WHEN 6 THEN concat('{"rows": [{"v": ', v, ', "k": ', k, ', "x": 1E22}, {"v": ', event_id % 50, ', "k": ', k, ', "ü": -0}]}')
             ELSE concat('{"rows": [{"v": ', v, ', "k": ', k, '}, {"v": ', event_id % 50, ', "k": ', k, '}]}')
           END AS body""",
        "value / 1e2 AS latency_s",
        """CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 503 WHEN event_type = 'error' THEN 500
                ELSE 200 END AS status""",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from(table(spark, sf_dir, "events"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, slice, label, score from labelled documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(documents, "doc_id").selectExpr(
        "doc_id AS row_id", "lang AS slice", "quality AS label", "(n_chars % 1000) / 1e3 AS score"
    )


def scores_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_name, slice, label, score from all line items; a supplier stands for a model."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('s', l_suppkey) AS model_name",
        "l_returnflag AS slice",
        "CASE WHEN l_suppkey % 10 = 3 AND l_linenumber = 4 THEN NULL WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS label",
        # Some suppliers lack a score here and there, one in ten has none at all.
        "CASE WHEN l_suppkey % 10 = 7 OR (l_suppkey % 10 = 5 AND l_linenumber = 2) THEN NULL ELSE (l_partkey % 1000) / 1e3 END AS score",
    )


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, target, f0, f1, f2: the tabular training set."""
    owner = table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_acctbal", "c_nationkey")
    return orders(spark, sf_dir).join(owner, "o_custkey").selectExpr(
        "o_orderkey AS row_id",
        "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target",
        "o_totalprice AS f0",
        "c_acctbal AS f1",
        "c_nationkey * 1e0 AS f2",
    )


def owned_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set with the model and the market segment that each row belongs to."""
    owner = table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_acctbal", "c_nationkey", "c_mktsegment AS segment")
    return orders(spark, sf_dir).join(owner, "o_custkey").selectExpr(
        "o_orderkey AS row_id",
        "concat('m', o_custkey) AS model_name",
        "segment",
        "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target",
        "o_totalprice AS f0",
        "c_acctbal AS f1",
        "c_nationkey * 1e0 AS f2",
    )


DATASET_FEATURES = ("f0", "f1", "f2")
