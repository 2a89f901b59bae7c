"""SQL that an independent engine runs on the same tables to check the queries."""

from __future__ import annotations

import importlib
import pkgutil

from tallyspan.oracles.base import compose


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    modules = [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]
    for module in modules:
        for name, sql in getattr(module, "SQL", {}).items():
            if name in found:
                raise ValueError(f"two statements for {name}")
            found[name] = sql
    return {name: compose(sql) for name, sql in found.items()}
