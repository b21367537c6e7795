"""Joins that choose their way by a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most so many narrow rows (some tens of MB).
BROADCAST_ROWS = 250_000


def checked_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``small``, broadcast if its row count is within ``max_rows``, else by shuffling both sides.

    ``small`` should be materialised and narrow: it is counted here.
    """
    within = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if within else small, on, how)
