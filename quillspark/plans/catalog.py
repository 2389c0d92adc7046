"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from quillspark.plans import briefing_queries, insight_queries, items_queries

QUERIES: dict = {**items_queries.QUERIES, **insight_queries.QUERIES, **briefing_queries.QUERIES}
ORACLES: dict = {**items_queries.ORACLES, **insight_queries.ORACLES, **briefing_queries.ORACLES}
