"""Registered queries: each reads the given tables and has, where possible, a SQL twin."""

from __future__ import annotations

from importlib import import_module

from vigilbus.queries.registry import REGISTRY

_FAMILIES = ["scans", "signals", "packets", "frames", "rules", "windows", "evaluation",
             "injection", "federated", "privacy", "streams", "models", "declared"]


def load_all() -> dict:
    for family in _FAMILIES:
        import_module(f"vigilbus.queries.{family}")
    return dict(REGISTRY)
