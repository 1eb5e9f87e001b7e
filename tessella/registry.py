"""All queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import pkgutil

from tessella import plans
from tessella.plans.base import ORACLES, QUERIES

for _module in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"{plans.__name__}.{_module.name}")

FLAGSHIP = "AG8"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
