"""Query definitions over the given tables."""

from __future__ import annotations

from importlib import import_module

from relyard.plans.catalog import CATALOG, Query

MODULES = ("policy_plans", "serving_plans", "data_plans", "state_plans", "streaming_plans")


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"relyard.plans.{module}")
    return dict(CATALOG)
