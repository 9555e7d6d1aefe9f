"""Registered queries by group; importing this package registers them all."""

from tessera.plans import decisions, graph, law_questions, matching, profile, rest, rules, stores  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
