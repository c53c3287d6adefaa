"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from leafscan import plans
from leafscan.plans.base import ORACLE, QUERIES, QueryFn

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module not in ("base", "registry"):
        importlib.import_module(f"leafscan.plans.{_module}")


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
