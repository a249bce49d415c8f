"""All named queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from loanweave.plans.catalog import (
    collateral,
    features,
    gold,
    models,
    performance,
    pool,
    quality,
    silver,
    sinks,
    sources,
)
from loanweave.plans.catalog.base import Catalog


def load() -> Catalog:
    catalog = Catalog()
    for area in (
        sources, silver, gold, collateral, performance, quality, features, models, pool, sinks,
    ):
        area.register(catalog)
    return catalog
