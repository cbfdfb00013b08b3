"""Operators for building training corpora. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark import cloudpickle

# Tasks get the functions by value: executors need numpy and pandas, but no copy of this package.
for _found in pkgutil.iter_modules(__path__):
    if _found.name != "queries":
        cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_found.name}"))
