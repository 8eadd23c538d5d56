"""Imports every query module and exposes the finished registry."""

from __future__ import annotations

import importlib

from landshift.plans import twins  # noqa: F401
from landshift.plans.registry import ORACLES, QUERIES, expand

MODULES = ("change", "rollup", "scenes", "labels", "patches", "regions", "terrain", "embed", "raster", "audit")

for _name in MODULES:
    importlib.import_module(f"landshift.plans.{_name}")


def reference_sql() -> dict[str, str]:
    return {name: expand(sql) for name, sql in ORACLES.items()}
