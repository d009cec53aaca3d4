"""All registered queries. Each plan module holds NAME -> (function, oracle SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("condition_plans", "link_plans", "metric_plans", "model_plans", "audit_plans", "gate_plans")


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        entries = import_module(f"tallyspark.plans.{m}").QUERIES
        clash = out.keys() & entries.keys()
        assert not clash, clash
        out.update(entries)
    return out


def queries() -> dict:
    return {k: v[0] for k, v in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _all().items() if v[1]}
