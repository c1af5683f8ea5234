"""All queries of the core, by name, and the SQL they are checked against."""

from __future__ import annotations

import importlib

from quillon.plans.registry import ORACLES, QUERIES

for _module in ("drift_queries", "sampling_queries", "retrieval_queries", "measure_queries", "grid_queries", "scoring_queries", "governance_queries"):
    importlib.import_module(f"quillon.plans.{_module}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
