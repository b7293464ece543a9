"""All registered queries, by importing the modules that register them."""

import importlib

from trajlytics.queries.registry import REGISTRY, callables, checks

MODULES = ["contracts", "splits", "sources", "features", "closed_form", "scoring", "intervals", "selective", "resampling", "audit", "library", "hierarchical", "neighbors", "lifetime", "invariants", "controls", "nulls"]

for _name in MODULES:
    importlib.import_module(f"trajlytics.queries.{_name}")

__all__ = ["REGISTRY", "callables", "checks"]
