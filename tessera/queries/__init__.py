"""Registered queries and the SQL that states the same."""

from . import catalog, evaluation, relational, retrieval, telemetry, text

_ALL = [m.R for m in (relational, telemetry, text, retrieval, catalog, evaluation)]
QUERIES = {k: q for r in _ALL for k, q in r.queries.items()}
ORACLE = {k: q for r in _ALL for k, q in r.sql.items()}
