"""Queries over the test tables, one module per family, each with its equivalent SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("store", "validation", "evaluation", "monitoring", "timeseries", "features", "modelling", "ingest", "streams")


def all_registries():
    return [import_module(f"registry.{name}").REG for name in FAMILIES]
