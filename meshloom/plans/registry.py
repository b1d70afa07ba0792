"""All queries of the library with their DuckDB twins, collected from the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("q_graph", "q_partition", "q_params", "q_links", "q_private", "q_models", "q_gradients", "q_shares", "q_kept", "q_reports")


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= module.ORACLE
    return found
