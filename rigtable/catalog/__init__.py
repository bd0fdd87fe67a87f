"""Every operator as a query over the given tables, beside its SQL where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("geometry", "labels", "tracking", "views", "robot", "models")


def _collect(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"rigtable.catalog.{name}"), attr))
    return out


def queries() -> dict[str, Callable]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
