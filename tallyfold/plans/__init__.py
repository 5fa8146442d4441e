"""Whole queries over the given tables, registered with their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

from tallyfold.plans.registry import ORACLES, QUERIES, Query

MODULES = ("rule_queries", "reconcile_queries", "window_queries", "source_queries", "lineage_queries", "ledger_queries", "check_queries", "object_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"tallyfold.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracles() -> dict[str, str]:
    _load()
    return ORACLES
