"""Every registered query of the monitoring engine."""

from __future__ import annotations

from phmspark.plans import evaluation, features, geometry, matrices, models, quality, series, streams  # noqa: F401
from phmspark.plans.base import REGISTRY


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
