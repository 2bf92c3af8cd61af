"""Queries over the driver's tables and their SQL, by operator."""

from __future__ import annotations

from recollect.plans import changes, chunking, code, flows, lists, memory, reports

_PARTS = [memory, chunking, code, reports, changes, flows, lists]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
