"""Registered queries over the synthetic tables, with their SQL."""

from tidemill.plans import coding, company, decisions, demands, imports, ledger, lexical, matching, more, review, search, stats  # noqa: F401
from tidemill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
