"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from wheelwork.plans import accidents, evaluation, figures, files, mobility, network, places, provided, steps, ways

_PLANS = [mobility, figures, places, network, accidents, evaluation, steps, ways, files, provided]
QUERIES = {name: f for p in _PLANS for name, f in p.QUERIES.items()}
SQL = {name: sql for p in _PLANS for name, sql in p.SQL.items()}
