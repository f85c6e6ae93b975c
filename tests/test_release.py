"""Promotion, rollback and undo on a small registry."""

import pytest
from pyspark.sql import functions as F

from relyard.operators import policy, registry, release
from relyard.sources import release_table
from tests.test_policy import ALIASES, VALID, VERSIONS

BASE = {**VALID, "source_run_id": "r"}


@pytest.fixture()
def state(spark):
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model_name string")
    aliases = spark.createDataFrame(
        [("a", "candidate", 2), ("a", "prod", 1), ("a", "champion", 1), ("b", "candidate", 1), ("c", "prod", 1)], ALIASES
    )
    versions = spark.createDataFrame(
        [("a", 1, {**BASE, "release_status": "prod"}), ("a", 2, BASE), ("b", 1, BASE), ("c", 1, BASE)], VERSIONS
    )
    runs = spark.createDataFrame([("r",)], "run_id string")
    return models, aliases, versions, runs


def as_dict(aliases):
    return {(r["model_name"], r["alias"]): r["version"] for r in aliases.collect()}


def tags_of(versions):
    return {(r["model_name"], r["version"]): r["tags"] for r in versions.collect()}


def promote(models, aliases, versions, runs):
    return release.apply_promotion(policy.evaluate(models, aliases, versions, runs), aliases, versions)


def test_promotion_moves_aliases_and_writes_evidence(state):
    aliases, versions = promote(*state)
    assert as_dict(aliases) == {
        ("a", "candidate"): 2, ("a", "prod"): 2, ("a", "champion"): 2,
        ("b", "candidate"): 1, ("b", "prod"): 1, ("b", "champion"): 1, ("c", "prod"): 1,
    }
    tags = tags_of(versions)
    assert tags["a", 2]["release_status"] == "prod" and tags["a", 2]["promoted_from_alias"] == "candidate"
    assert tags["a", 2]["previous_prod_version"] == "1" and tags["a", 1]["release_status"] == "previous_prod"
    assert "previous_prod_version" not in tags["b", 1]
    assert tags["c", 1] == BASE


def test_dry_run_changes_nothing(state):
    models, aliases, versions, runs = state
    before = as_dict(aliases), tags_of(versions)
    policy.exit_status(policy.evaluate(models, aliases, versions, runs)).collect()
    assert (as_dict(aliases), tags_of(versions)) == before


def test_rollback_undo_and_blocked(state):
    models, *_, runs = state
    aliases, versions = promote(*state)
    back, versions_back, blocked = release.rollback(models, aliases, versions)
    assert as_dict(back)["a", "prod"] == 1 and as_dict(back)["a", "champion"] == 2
    assert tags_of(versions_back)["a", 1]["previous_prod_version"] == "2"
    assert tags_of(versions_back)["a", 1]["release_status"] == "previous_prod"
    assert {r["model_name"]: r["reason"] for r in blocked.collect()} == {
        "b": "MISSING_PREVIOUS_PROD_VERSION", "c": "MISSING_PREVIOUS_PROD_VERSION",
    }
    undone, _, _ = release.rollback(models, back, versions_back)
    assert as_dict(undone)["a", "prod"] == 2


def test_rolled_back_candidate_cannot_be_promoted_again(state):
    models, *_, runs = state
    back, versions, _ = release.rollback(models, *promote(*state))
    again = policy.evaluate(models, back, versions, runs).filter("model_name = 'a'").first()
    assert [v["code"] for v in again["errors"]] == ["INVALID_RELEASE_STATUS"]


def test_rollback_without_prod_alias(spark, state):
    models, _, versions, _ = state
    only = spark.createDataFrame([("a", "candidate", 2)], ALIASES)
    plan = {r["model_name"]: r["reason"] for r in release.rollback_plan(models, only, versions).collect()}
    assert set(plan.values()) == {"MISSING_PROD_ALIAS"}


def test_consistency_audit_finds_what_rollback_leaves(state):
    models, *_ = state
    back, versions, _ = release.rollback(models, *promote(*state))
    found = {r["model_name"]: (r["champion_differs"], r["status_differs"]) for r in release.alias_consistency(back, versions).collect()}
    assert found["a"] == (True, True) and "b" not in found


def test_registration_takes_only_true_gates_and_counts_on(spark):
    from datetime import datetime

    rows = [
        ("m", "r1", "train", datetime(2024, 1, 2), {"git_sha": " s ", "row_count": " "}, "true"),
        ("m", "r2", "train", datetime(2024, 1, 1), {}, " TRUE\n"),
        ("m", "r3", "train", datetime(2024, 1, 3), {}, "false"),
        ("m", "r4", "evaluate", datetime(2024, 1, 3), {}, "true"),
        ("n", "r5", "train", datetime(2024, 1, 3), {}, "yes"),
    ]
    runs = spark.createDataFrame(
        rows, "model_name string, run_id string, step string, start_time timestamp_ntz, tags map<string,string>, gate_ok string"
    )
    versions = spark.createDataFrame([("m", 4, {})], VERSIONS)
    new = registry.register_versions(runs, versions)
    got = {r["version"]: (r["source_run_id"], r["tags"]) for r in new.collect()}
    fixed = {"gate": "passed", "release_status": "candidate"}
    assert got == {
        5: ("r2", {"source_run_id": "r2", **fixed}),
        6: ("r1", {"source_run_id": "r1", "git_sha": "s", **fixed}),
    }
    assert registry.candidate_changes(new).first().asDict() == {"model_name": "m", "alias": "candidate", "version": 6}


def test_references(spark):
    refs = spark.createDataFrame(
        [(i, u) for i, u in enumerate(["models:/a@prod", "models:/a/2", "models:/a/9", "models:/z@prod", "runs:/r/model", "junk"])],
        "id int, uri string",
    )
    aliases = spark.createDataFrame([("a", "prod", 1)], ALIASES)
    versions = spark.createDataFrame([("a", 1, "r"), ("a", 2, " ")], "model_name string, version bigint, source_run_id string")
    runs = spark.createDataFrame([("r",)], "run_id string")
    got = {r["id"]: (r["version"], r["run_id"], r["run_found"]) for r in registry.resolve_refs(refs, aliases, versions, runs).collect()}
    assert got == {
        0: (1, "r", True), 1: (2, None, False), 2: (None, None, False),
        3: (None, None, False), 4: (None, "r", True), 5: (None, None, False),
    }


def test_promotion_from_another_alias_moves_prod_too(spark, state):
    """A decision about another target alias still takes effect, and what is prod now becomes the previous version."""
    models, aliases, versions, runs = state
    decided = policy.evaluate(models, aliases, versions, runs, to_alias="staging")
    new_aliases, new_versions = release.apply_promotion(decided, aliases, versions)
    assert as_dict(new_aliases)["a", "prod"] == 2 and as_dict(new_aliases)["b", "prod"] == 1
    assert tags_of(new_versions)["a", 2]["previous_prod_version"] == "1"
    same = spark.createDataFrame([("b", "candidate", 1), ("b", "prod", 1)], ALIASES)
    decided = policy.evaluate(models, same, versions, runs, to_alias="staging")
    _, tagged = release.apply_promotion(decided, same, versions)
    own = tags_of(tagged)["b", 1]
    assert tagged.count() == versions.count() and (own["release_status"], own["previous_prod_version"]) == ("previous_prod", "1")


def test_rollback_to_a_version_that_is_gone(spark, state):
    models, *_ = state
    versions = spark.createDataFrame([("a", 2, {**BASE, "previous_prod_version": "99999"}), ("b", 1, {**BASE, "previous_prod_version": "x"})], VERSIONS)
    aliases = spark.createDataFrame([("a", "prod", 2), ("b", "prod", 1)], ALIASES)
    plan = {r["model_name"]: r["reason"] for r in release.rollback_plan(models, aliases, versions).collect()}
    assert plan == {"a": "VERSION_NOT_FOUND", "b": "VERSION_NOT_FOUND", "c": "MISSING_PROD_ALIAS"}


def test_registration_twice_adds_nothing(spark):
    runs = spark.createDataFrame(
        [("r1", "m", "train", "2024-01-01 00:00:00", {"git_sha": "s"}, "true"), ("r2", "m", "train", "2024-01-02 00:00:00", {}, "true")],
        "run_id string, model_name string, step string, start_time string, tags map<string,string>, gate_ok string",
    ).selectExpr("run_id", "model_name", "step", "CAST(start_time AS TIMESTAMP_NTZ) AS start_time", "tags", "gate_ok")
    none = spark.createDataFrame([], "model_name string, version bigint, source_run_id string, tags map<string,string>, created_at timestamp_ntz")
    first = registry.register_versions(runs, none)
    assert sorted((r["version"], r["source_run_id"]) for r in first.collect()) == [(1, "r1"), (2, "r2")]
    assert registry.register_versions(runs, first.select(*none.columns)).count() == 0


def test_stored_state_changes_as_one(spark, state, location):
    """Aliases and tags are one write; a path that holds a state is refused and stays as it was."""
    models, aliases, versions, runs = state
    first = release_table.store(aliases, versions, f"{location}/first")
    a, v = release_table.read(spark, first)
    assert as_dict(a) == as_dict(aliases) and tags_of(v) == tags_of(versions)
    changed = release.apply_promotion(policy.evaluate(models, a, v, runs), a, v)
    second = release_table.store(*changed)
    assert as_dict(release_table.read(spark, second)[0])["a", "prod"] == 2
    with pytest.raises(Exception, match="(?i)exists"):
        release_table.store(*changed, first)
    assert as_dict(release_table.read(spark, first)[0]) == as_dict(aliases)


def test_two_writers_from_one_state(spark, state, location):
    """Both start before either has stored; each leaves its own state whole, and a failed one leaves the other's as it is."""
    models, aliases, versions, runs = state
    first = release_table.store(aliases, versions, f"{location}/first")
    mine, theirs = release_table.read(spark, first), release_table.read(spark, first)
    promoted = release.apply_promotion(policy.evaluate(models, *mine, runs), *mine)
    retagged = theirs[0], theirs[1].withColumn("tags", F.map_concat(F.map_filter("tags", lambda k, _: k != "owner"), F.create_map(F.lit("owner"), F.lit("them"))))
    a, b = release_table.store(*promoted), release_table.store(*retagged)
    broken = retagged[0].withColumn("version", F.raise_error(F.lit("lost"))), retagged[1]
    with pytest.raises(Exception, match="lost"):
        release_table.store(*broken, f"{location}/broken")
    assert as_dict(release_table.read(spark, a)[0])["a", "prod"] == 2
    assert as_dict(release_table.read(spark, b)[0]) == as_dict(aliases)
    assert all(t["owner"] == "them" for t in tags_of(release_table.read(spark, b)[1]).values())
    assert all("owner" not in t for t in tags_of(release_table.read(spark, a)[1]).values())
