"""Policy rules on literal registries: one case per rule, short circuit, warnings, dry run."""

import json

import pytest

from relyard.operators import policy

VALID = {
    "dataset_fingerprint": "abc",
    "git_sha": "deadbeef",
    "config_hash": "cfg123",
    "training_run_id": "trainrun123",
    "gate": "passed",
    "release_status": "candidate",
}
ALIASES = "model_name string, alias string, version bigint"
VERSIONS = "model_name string, version bigint, tags map<string,string>"


def decide(spark, tags, aliases, runs=(), from_alias="candidate"):
    models = spark.createDataFrame([("m",)], "model_name string")
    versions = spark.createDataFrame([("m", 1, tags)] if tags is not None else [], VERSIONS)
    pointers = spark.createDataFrame([("m", a, v) for a, v in aliases], ALIASES)
    known = spark.createDataFrame([(r,) for r in runs], "run_id string")
    return policy.evaluate(models, pointers, versions, known, from_alias)


def codes(row, kind="errors"):
    return [v["code"] for v in row[kind]]


def test_valid_candidate_is_allowed_with_one_warning(spark):
    row = decide(spark, VALID, [("candidate", 1)]).first()
    assert row["allowed"] and codes(row) == []
    assert codes(row, "warnings") == ["MISSING_SOURCE_RUN_ID"]
    assert row["candidate_version"] == "1" and row["current_prod_version"] is None


def test_missing_alias_stops_everything_else(spark):
    row = decide(spark, {}, [("prod", 1)]).first()
    assert codes(row) == ["MISSING_ALIAS"] and codes(row, "warnings") == []
    assert not row["allowed"] and row["candidate_tags_subset"] is None
    assert row["errors"][0]["message"] == "Promotion blocked: alias 'candidate' does not exist."


@pytest.mark.parametrize("key", ["dataset_fingerprint", "git_sha", "config_hash", "training_run_id"])
@pytest.mark.parametrize("value", ["", " \t", None])
def test_each_required_tag(spark, key, value):
    row = decide(spark, {**VALID, key: value}, [("candidate", 1)]).first()
    assert codes(row) == ["MISSING_REQUIRED_TAGS"]
    assert row["errors"][0]["details"]["missing"] == [key]


def test_absent_tags_are_listed_in_declared_order(spark):
    row = decide(spark, {"gate": "passed", "release_status": "candidate"}, [("candidate", 1)]).first()
    assert row["errors"][0]["details"]["missing"] == [
        "dataset_fingerprint", "git_sha", "config_hash", "training_run_id",
    ]


def test_gate_status_and_noop(spark):
    assert codes(decide(spark, {**VALID, "gate": "failed"}, [("candidate", 1)]).first()) == ["GATE_NOT_PASSED"]
    assert codes(decide(spark, {**VALID, "gate": " passed "}, [("candidate", 1)]).first()) == []
    wrong = decide(spark, {**VALID, "release_status": "something_else"}, [("candidate", 1)]).first()
    assert codes(wrong) == ["INVALID_RELEASE_STATUS"]
    assert codes(decide(spark, VALID, [("candidate", 1), ("prod", 1)]).first()) == ["NOOP_PROMOTION"]


def test_status_is_compared_with_the_alias_in_use(spark):
    tags = {**VALID, "release_status": "staging"}
    assert codes(decide(spark, tags, [("staging", 1)], from_alias="staging").first()) == []


def test_all_errors_are_collected_in_order(spark):
    row = decide(spark, {}, [("candidate", 1), ("prod", 1)]).first()
    assert codes(row) == ["MISSING_REQUIRED_TAGS", "GATE_NOT_PASSED", "INVALID_RELEASE_STATUS", "NOOP_PROMOTION"]


def test_source_run_warnings(spark):
    tags = {**VALID, "source_run_id": " run-1 "}
    assert codes(decide(spark, tags, [("candidate", 1)], ["run-1"]).first(), "warnings") == []
    lost = decide(spark, tags, [("candidate", 1)], ["run-2"]).first()
    assert lost["allowed"] and codes(lost, "warnings") == ["SOURCE_RUN_ID_NOT_FOUND"]
    assert lost["warnings"][0]["details"]["run_id"] == "run-1"


def test_alias_to_missing_version(spark):
    assert codes(decide(spark, None, [("candidate", 7)]).first()) == ["VERSION_NOT_FOUND"]


def test_json_and_text_forms(spark):
    decisions = decide(spark, {**VALID, "gate": "failed"}, [("candidate", 1)])
    document = json.loads(policy.as_json(decisions).first()["decision"])
    assert document["allowed"] is False and document["context"]["current_prod_version"] is None
    assert document["errors"][0]["details"] == {"actual": "failed", "expected": "passed"}
    assert policy.as_json(decisions).first()["decision"] == json.dumps(document, sort_keys=True, separators=(",", ":"))
    lines = [r["line"] for r in policy.as_text(decisions).orderBy("line_no").collect()]
    assert lines[0] == "allowed=False"
    assert lines[1].startswith("ERROR GATE_NOT_PASSED: ") and lines[1].endswith("{'expected': 'passed', 'actual': 'failed'}")
    assert lines[2].startswith("WARN  MISSING_SOURCE_RUN_ID: ") and lines[-1].startswith("context={'model_name': 'm', ")


def test_text_and_indented_forms_of_awkward_values(spark):
    tags = {**VALID, "gate": "it's\n\\ok", "release_status": 'say "no" and it\'s', "git_sha": 'a"b\té'}
    decisions = decide(spark, tags, [("candidate", 1)])
    lines = [r["line"] for r in policy.as_text(decisions).orderBy("line_no").collect()]
    assert all("\n" not in x for x in lines)
    gate = next(x for x in lines if "GATE_NOT_PASSED" in x)
    status = next(x for x in lines if "INVALID_RELEASE_STATUS" in x)
    assert gate.endswith("'actual': " + repr(tags["gate"]) + "}") and repr(tags["release_status"]) in status
    assert repr(tags["git_sha"]) in lines[-1]
    compact, indented = (policy.as_json(decisions, n).first()["decision"] for n in (None, 2))
    assert indented == json.dumps(json.loads(compact), indent=2, sort_keys=True)


def test_exit_status(spark):
    assert policy.exit_status(decide(spark, VALID, [("candidate", 1)])).first()["exit_status"] == 0
    assert policy.exit_status(decide(spark, {}, [("candidate", 1)])).first()["exit_status"] == 2
