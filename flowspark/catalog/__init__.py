"""All registered queries; every module adds its own to `base`."""

from __future__ import annotations

import importlib

MODULES = ("rows", "tables", "files", "text", "learning", "timeseries", "streams")


def load():
    from flowspark.catalog import base

    for module in MODULES:
        importlib.import_module(f"flowspark.catalog.{module}")
    return base.QUERIES, base.ORACLE
