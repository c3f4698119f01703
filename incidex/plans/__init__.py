"""Queries over the driver tables, each paired with its SQL check."""

from __future__ import annotations

import importlib

_MODULES = ("vocabulary", "splitting", "gates", "rules", "scoring", "impact", "bins", "rollups", "files", "learning")


def load_all():
    from incidex.plans.registry import REGISTRY

    for name in _MODULES:
        try:
            importlib.import_module(f"incidex.plans.{name}")
        except ModuleNotFoundError as exc:
            if exc.name != f"incidex.plans.{name}":
                raise
    return REGISTRY
