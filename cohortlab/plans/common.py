"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree; 0.0 added turns -0.0 into 0.0."""
    return df.withColumns({name: F.round(F.col(f"`{name}`"), digits) + F.lit(0.0) for name, kind in df.dtypes if kind == "double"})


def sine_weights(n: int, phase: int = 0) -> list[float]:
    """sin(1 + phase), sin(2 + phase), ...: the stand-in weights of a linear head."""
    import math

    return [math.sin(i + 1 + phase) for i in range(n)]


def position_sum(array: str):
    """Sum of (position · value): tells apart any two layouts of the same values; the tests compare whole arrays."""
    return F.aggregate(F.transform(F.col(array), lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda total, x: total + x)
