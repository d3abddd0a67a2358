"""The queries of this subpackage and their SQL."""

from pagelake.llm import language, leakage, lookalikes, mixing, names, packing, pairs, scans, spam

_MODULES = (lookalikes, scans, names, packing, pairs, language, leakage, mixing, spam)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
