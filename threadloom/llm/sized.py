"""Broadcasts behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrow rows up to which a side is broadcast: some tens of megabytes.
BROADCAST_ROWS = 400_000


def checked(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if it has at most `limit` rows; else as it is, for the planner to decide."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table
