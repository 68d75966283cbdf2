"""Imports every query module so that the registry is full."""

import importlib
import pkgutil

import telemill.plans as plans
from telemill.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
    importlib.import_module(f"telemill.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
