"""Every query of the library with its SQL counterpart."""

from __future__ import annotations

from . import analytics, jobs, reporting, text_queries

QUERIES: dict = {**analytics.QUERIES, **text_queries.QUERIES, **reporting.QUERIES, **jobs.QUERIES}
ORACLES: dict = {**analytics.ORACLES, **text_queries.ORACLES, **reporting.ORACLES, **jobs.ORACLES}
