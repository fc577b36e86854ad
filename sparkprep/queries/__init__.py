"""Every query of the tabular operators, by name, with its SQL."""

from __future__ import annotations

from importlib import import_module

from sparkprep.queries.base import Query

AREAS = ("profile", "clean", "features", "measures", "models")


def queries() -> dict[str, Query]:
    return {k: q for area in AREAS for k, q in import_module(f"sparkprep.queries.{area}").book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for area in AREAS for k, q in import_module(f"sparkprep.queries.{area}").book.sql.items()}
