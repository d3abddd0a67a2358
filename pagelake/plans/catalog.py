"""All queries of the core and their SQL."""

from pagelake.plans import hierarchies, ingest, records, terminology

_MODULES = (ingest, terminology, records, hierarchies)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
