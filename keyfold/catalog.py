"""The registered queries of the library and their SQL."""

from __future__ import annotations

from keyfold.queries import feeds, health, state, traffic, windows

QUERIES = feeds.QUERIES | windows.QUERIES | state.QUERIES | traffic.QUERIES | health.QUERIES
SQL = feeds.SQL | windows.SQL | state.SQL | traffic.SQL | health.SQL
