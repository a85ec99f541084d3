"""Joining a large table with a table that is expected to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 10_000


def join_small(
    large: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join with a broadcast when ``small`` really is small, else with an ordinary join.

    ``small`` is computed here, up to the bound. When it fits, its rows are broadcast, so the
    large side is not shuffled on what is often a two-valued key.
    """
    rows = small.limit(MAX_BROADCAST_ROWS + 1).collect()
    if len(rows) > MAX_BROADCAST_ROWS:
        return large.join(small, on, how)
    local = large.sparkSession.createDataFrame(rows, small.schema)
    return large.join(F.broadcast(local), on, how)
