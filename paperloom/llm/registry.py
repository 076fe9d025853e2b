"""All queries of the subpackage with their SQL twins."""

from __future__ import annotations

from . import queries

QUERIES = dict(queries.QUERIES)
SQL = dict(queries.SQL)
