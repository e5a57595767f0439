"""Every query of the document engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLE.
MODULES: tuple[str, ...] = ("doctide.plans.units", "doctide.plans.stores", "doctide.plans.text", "doctide.plans.layout", "doctide.plans.batches", "doctide.plans.sequences", "doctide.plans.pieces")
FLAGSHIP = "dedup_units"


def queries() -> dict:
    return {k: v for name in MODULES for k, v in import_module(name).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for name in MODULES for k, v in import_module(name).ORACLE.items()}
