"""Cleaning: capping, and the binary risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.describe import iqr_bounds


def cap(value: Column, low: Column, high: Column) -> Column:
    """Values beyond a fence become the fence; missing stays missing and NaN becomes null."""
    real = F.nullif(value, F.lit(float("nan")))
    return F.when(real < low, low).when(real > high, high).otherwise(real)


def iqr_cap(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replace outliers of ``columns`` by the fences of ``fit_on`` (default: the table itself). The fences are one broadcast row."""
    bounds = iqr_bounds(fit_on if fit_on is not None else df, columns)
    pick = lambda c, side: F.max(F.when(F.col("column_name") == c, F.col(side)))
    row = bounds.agg(F.struct(*[F.struct(pick(c, "low").alias("low"), pick(c, "high").alias("high")).alias(c) for c in columns]).alias("_fences"))
    out = df.crossJoin(F.broadcast(row))
    return out.withColumns({c: cap(F.col(f"`{c}`"), F.col(f"_fences.`{c}`.low"), F.col(f"_fences.`{c}`.high")) for c in columns}).drop("_fences")


def risk_binarize(risk: Column, least: int = 2) -> Column:
    """1 from ``least`` upwards; a missing risk is 0."""
    return F.coalesce((risk >= least).cast("long"), F.lit(0).cast("long"))
