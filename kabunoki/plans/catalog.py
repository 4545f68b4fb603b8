"""All queries by name and their equivalents in SQL."""

from __future__ import annotations

from . import companies, control, market, models, records

MODULES = (market, companies, models, records, control)
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
