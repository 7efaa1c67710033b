"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from . import cleaning, files, grids, learned, models_sql, places, selection, series, shapes, zones, zones_areas  # noqa: F401  each registers its queries
from .registry import QUERIES, TWINS, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
