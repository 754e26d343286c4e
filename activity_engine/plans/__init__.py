"""Ready-made queries. Importing this package registers all of them."""

from activity_engine.plans import (  # noqa: F401
    album_queries,
    calendar_queries,
    conversation_queries,
    join_queries,
    merge_queries,
    quality_queries,
    recommendation_queries,
    report_queries,
    text_queries,
    vector_queries,
    window_queries,
)
from activity_engine.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
