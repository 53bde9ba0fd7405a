"""Queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import collecting, features, indexing, measures, overview, quotes, reports, screening

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (quotes, indexing, screening, reports, overview, measures, collecting, features):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
