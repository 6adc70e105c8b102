"""All queries of the library, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

from .plans import registry

FLAGSHIP = "B12_doc_percent"
MODULES = ("scalars", "documents", "evaluation", "preparation", "citing", "rest")
for _m in MODULES:
    importlib.import_module(f".plans.{_m}", __package__)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
