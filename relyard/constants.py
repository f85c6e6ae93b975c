"""Fixed values of the release contracts. Results depend on them; do not edit."""

from __future__ import annotations

# Contract schema versions.
DATASET_FINGERPRINT_VERSION = "dataset_fingerprint/v1"
MODEL_REF_VERSION = "model_ref/v1"
FEATURE_STATS_VERSION = "feature_stats/v1"

# Tag keys that a model version must carry, in the order they are reported.
REQUIRED_TAGS = ("dataset_fingerprint", "git_sha", "config_hash", "training_run_id")

# Tag keys shown in the decision context.
CONTEXT_TAGS = (
    "gate",
    "release_status",
    "source_run_id",
    "dataset_fingerprint",
    "git_sha",
    "config_hash",
    "training_run_id",
)

# Tag keys copied from a run onto the model version it produced.
COPIED_TAGS = (
    "git_sha",
    "dataset_content_hash",
    "dataset_schema_hash",
    "dataset_fingerprint",
    "row_count",
    "data_source_uri",
    "config_hash",
    "training_run_id",
)

# Aliases and tag values.
CANDIDATE = "candidate"
PROD = "prod"
CHAMPION = "champion"
SHADOW = "shadow"
CANARY = "canary"
GATE_PASSED = "passed"
PREVIOUS_PROD = "previous_prod"

# Violation messages.
MISSING_ALIAS_MESSAGE = "Promotion blocked: alias '{alias}' does not exist."
MISSING_TAGS_MESSAGE = "Promotion blocked: candidate model version is missing required metadata tags."
GATE_MESSAGE = "Promotion blocked: model gate status is not 'passed'."
STATUS_MESSAGE = "Promotion blocked: candidate release_status is not eligible for promotion."
NOOP_MESSAGE = "Promotion blocked: candidate is already the current prod version."
NO_SOURCE_RUN_MESSAGE = "Missing source_run_id tag; promotion will be less auditable."
SOURCE_RUN_NOT_FOUND_MESSAGE = "source_run_id tag is present but the MLflow run could not be fetched."

# Our own addition: an alias that points at a version row that is gone.
VERSION_NOT_FOUND_MESSAGE = "Promotion blocked: candidate model version does not exist."

# Training, evaluation and routing numbers.
TEST_SHARE = 0.2
SPLIT_SEED = 42
DECISION_THRESHOLD = 0.5
GATE_MIN_AUC = 0.95
MAX_ITER = 2000
CANARY_PCT = 10

# Default histogram bounds of the public Prometheus Python client, in seconds.
HISTOGRAM_BOUNDS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"),
)

# Spark type name -> column type name used inside schema hashes.
HASH_TYPE_NAMES = {
    "tinyint": "int8",
    "smallint": "int16",
    "int": "int32",
    "bigint": "int64",
    "float": "float32",
    "double": "float64",
    "boolean": "bool",
    "timestamp": "datetime64[us]",
    "timestamp_ntz": "datetime64[us]",
}
