"""Query catalogue: operators applied to the given tables."""
from __future__ import annotations

from importlib import import_module

MODULES = ["q_functions", "q_rules", "q_scoring", "q_patrol_plates", "q_ledger_sync", "q_corridor", "q_profiling", "q_eval"]


def load():
    """Import every catalogue module once; return (queries, SQL twins)."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES
    return QUERIES, ORACLES
