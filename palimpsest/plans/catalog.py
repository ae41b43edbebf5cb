"""All registered queries."""

import importlib

from palimpsest.plans.registry import ORACLES, QUERIES

AREAS = ("text", "spatial", "masks", "tiles", "audit", "trials", "governance", "pages", "packages",
         "lifecycle")
for area in AREAS:
    importlib.import_module(f"palimpsest.plans.{area}_queries")

__all__ = ["ORACLES", "QUERIES"]
