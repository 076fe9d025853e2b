"""All queries of the core with their SQL twins."""

from __future__ import annotations

from . import catalogue, details, library, nested

QUERIES = {**nested.QUERIES, **catalogue.QUERIES, **library.QUERIES, **details.QUERIES}
SQL: dict[str, str] = {**{k: v for k, v in catalogue.SQL.items() if k not in library.QUERIES}, **library.SQL, **details.SQL}
