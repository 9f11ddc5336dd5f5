"""All registered queries (importing the catalog modules fills the registry)."""

from __future__ import annotations

from . import catalog_decide, catalog_explain, catalog_metrics, catalog_models, catalog_monitor, catalog_prep, catalog_profile, catalog_quality, catalog_stream, catalog_windows  # noqa: F401
from .registry import REGISTRY


def queries():
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}
