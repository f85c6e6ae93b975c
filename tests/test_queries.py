"""Every query against its SQL on the smallest tables, and plan checks over all batch queries."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    """Same columns, types and rows as the SQL; and no cross join in the plan."""
    plans = []

    def build(session, sf_dir):
        df = QUERIES[name](session, sf_dir)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    outcome = compare(spark, duck, name, build, ORACLES.get(name), SF)
    assert not outcome.startswith("FAIL"), outcome
    assert "CartesianProduct" not in plans[0] and "BroadcastNestedLoopJoin" not in plans[0]


def test_column_pruning_reaches_the_scan(spark):
    plan = QUERIES["confusion_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_returnflag:string,l_linestatus:string>" in plan
    runs = QUERIES["latest_train_run"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" in runs and "o_totalprice" not in runs


def test_split_never_shuffles_dataset_rows(spark):
    """Only keys and counts move before the cuts are known; the wide rows are filtered in place."""
    from relyard.operators import split
    from relyard.sources import views

    plan = split.stratified_split(views.dataset(spark, SF), "target", "row_id")._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Window" not in main and "SortMergeJoin" not in main


def test_entry(spark):
    assert entry(spark).count() > 0


BINNED = (
    "policy_decision", "register_versions", "alias_history", "alias_as_of", "fingerprint_diff", "apply_promotion_tags",
)
LOOKUPS = ("predict_log", "shadow_mae", "resolve_model_refs", "score_proba", "score_by_ref", "register_versions", "stream_predict_log")


@pytest.mark.parametrize("name", BINNED)
def test_hot_group_plan_gives_the_same_rows(spark, duck, name, monkeypatch):
    """As if every group were too large for one task."""
    monkeypatch.setattr("relyard.operators.ordered.MAX_ROWS_PER_TASK", 0)
    outcome = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("name", LOOKUPS)
def test_salted_plan_gives_the_same_rows(spark, duck, name, monkeypatch):
    """As if every lookup were too large to broadcast."""
    monkeypatch.setattr("relyard.operators.ordered.MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr("relyard.operators.ordered.ROWS_PER_SALT", 3)
    outcome = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    assert outcome.startswith("ok"), outcome
