"""All registered queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from . import chat_queries, library_queries, text_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for part in (text_queries, chat_queries, library_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
