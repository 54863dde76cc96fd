"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from papyra.plans import chunks, documents, extras, journal, lookups, pages, runs, sheets, sources

_ALL = (lookups, pages, runs, journal, sheets, chunks, documents, extras, sources)
QUERIES = {name: q for m in _ALL for name, q in m.catalog.queries.items()}
SQL = {name: s for m in _ALL for name, s in m.catalog.sql.items()}
