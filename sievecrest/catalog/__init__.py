"""All registered queries. ``load()`` imports every catalog module once."""

from __future__ import annotations

import importlib
import pkgutil

from sievecrest.catalog.base import CHECK_SQL, QUERIES


def load():
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name != "base"):
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES, CHECK_SQL
