"""The registered queries and their DuckDB oracles."""

from tallyloom.operators import align, boards, candidates, cohort, gates, layout, leaves, ledger, nested, phrases, progress, ranges, records, rules, standards, state, timeline, trees  # noqa: F401  they register their queries
from tallyloom.plans.define import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
