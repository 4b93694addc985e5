"""All registered queries; importing this module fills the registry."""

import importlib

from evalgate.plans.registry import ORACLES, QUERIES

MODULES = ["metric_queries", "fold_queries", "rule_queries", "quality_queries", "ledger_queries", "grid_queries", "stream_queries"]
for _module in MODULES:
    importlib.import_module(f"evalgate.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
