"""Queries over the driver tables, one per operator, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("joins", "sequences", "nights", "cohorts", "studies", "inventory")


def load():
    """Import every query module and return the registry."""
    registry = import_module("sleepsignal.catalog.registry")
    for m in MODULES:
        import_module(f"sleepsignal.catalog.{m}")
    return registry
