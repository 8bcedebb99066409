"""All catalogs together."""

from __future__ import annotations

from plumbline.catalog import Query, evaluating, running, scanning, splitting

MODULES = (scanning, splitting, evaluating, running)


def queries() -> dict[str, Query]:
    return {name: q for module in MODULES for name, q in module.catalog.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.catalog.oracles.items()}
