"""All registered queries and their SQL twins."""

from __future__ import annotations

from acreage.plans import bent, business, details, evaluation_sql, layouts, lookups, records, streams, sweep_sql

_MODULES = [business, layouts, details, records, streams, bent, lookups]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in (*_MODULES, evaluation_sql, sweep_sql) for name, sql in m.ORACLE.items()}
