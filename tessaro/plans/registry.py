"""All queries of the core, and their SQL."""

from __future__ import annotations

from . import chunking, evaluation, facts, intervals, library, packing, parsing, relational, search, sequence, store, streams

_MODULES = (intervals, search, sequence, store, evaluation, parsing, relational, streams, packing, chunking, facts, library)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
