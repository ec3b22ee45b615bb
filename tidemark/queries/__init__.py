"""Registered queries: every operator applied to the test tables, with SQL where SQL can say it."""

from tidemark.queries.registry import QUERIES, SQL
from tidemark.queries import (  # noqa: F401  (importing registers)
    aggregates_q,
    features_q,
    forecast_q,
    rows_q,
    sources_q,
    splits_q,
    streaming_q,
    tsstats_q,
)

__all__ = ["QUERIES", "SQL"]
