"""Row-wise steps on streams: scoring and capping with frozen statistics need no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cohortlab.operators.clean import cap
from cohortlab.operators.scoring import with_scores
from pyspark.sql import functions as F


def score_stream(rows: DataFrame, features: str, weights: Sequence[float], bias: float = 0.0) -> DataFrame:
    """The linear head on a streaming (or static) table."""
    return with_scores(rows, features, weights, bias)


def cap_stream(rows: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Cap columns at fences fitted beforehand."""
    return rows.withColumns({c: cap(F.col(f"`{c}`"), F.lit(low), F.lit(high)) for c, (low, high) in fences.items()})
