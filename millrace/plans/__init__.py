"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("texts", "records", "corpus", "platform", "release", "structure", "clusters", "adapters")


def load() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
