"""Adapter views and the registered queries with their SQL checks."""

from __future__ import annotations

import importlib

_MODULES = ("quality", "preparation", "splitting", "distributions", "traffic", "drift", "experiments", "storage", "learning", "feeds")


def load_all() -> None:
    """Import the modules that register queries."""
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
