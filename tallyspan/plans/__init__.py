"""Registered queries, one module per family."""

from __future__ import annotations

import importlib
import pkgutil

from tallyspan.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return dict(QUERIES)
