"""Registered queries over the driver's tables, with their SQL; :func:`load` fills the registry."""

from __future__ import annotations

import importlib

MODULES = ("feature_queries", "calendar_queries", "trend_queries", "sampling_queries", "metric_queries", "trajectory_queries", "path_queries", "source_queries", "user_queries")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"pricepanel.plans.{name}")
