"""Every query of the library outside the training-data subpackage, with the SQL that checks it."""

from __future__ import annotations

from pressgauge.plans import analytics, checks, names, newsroom, operations, stories, texts, updates
from pressgauge.sources import feeds
from pressgauge.streaming import micro_batch

MODULES = (analytics, stories, operations, texts, names, newsroom, updates, checks, feeds, micro_batch)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
