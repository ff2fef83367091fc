"""The registered queries of this folder: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

import tracewell.llm


def queries() -> dict[str, Callable]:
    """Every function named opN_<name> in the modules of this folder, by N."""
    found = {}
    for module in pkgutil.iter_modules(tracewell.llm.__path__):
        if module.name != "queries":
            m = importlib.import_module(f"tracewell.llm.{module.name}")
            found |= {k: v for k, v in vars(m).items() if k.startswith("op") and k[2:3].isdigit() and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """ORACLE_SQL of the modules: those of the queries that SQL can express on whole tables."""
    found: dict[str, str] = {}
    for module in pkgutil.iter_modules(tracewell.llm.__path__):
        if module.name != "queries":
            found |= getattr(importlib.import_module(f"tracewell.llm.{module.name}"), "ORACLE_SQL", {})
    return found
