"""Queries over the driver tables."""

from placegrid.plans import (  # noqa: F401
    batch_queries,
    discovery_queries,
    file_queries,
    grid_queries,
    key_queries,
    lead_queries,
    media_queries,
    monitor_queries,
    panel_queries,
    state_queries,
    store_queries,
    stream_queries,
)
from placegrid.plans.registry import QUERIES  # noqa: F401
