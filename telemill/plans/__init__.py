"""Registered queries: one module per operator family."""

from telemill.plans import registry
from telemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "registry"]
