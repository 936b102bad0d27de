"""All queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import queries

QUERIES = queries.QUERIES
SQL = queries.SQL
