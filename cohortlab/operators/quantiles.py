"""Exact quantiles with linear interpolation, without a sort of the whole column.

A sketch brackets each quantile; one more pass counts what lies below the
bracket and how often each value inside it occurs. Only the values inside the
narrow brackets are ranked, so no task holds a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Relative rank error of the sketch is 1 / ACCURACY; brackets are four times as wide.
ACCURACY = 10_000


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value double) of the non-missing values; NaN counts as missing."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(cells: DataFrame, probabilities: Sequence[float], group: str = "column_name") -> DataFrame:
    """(group, probability, quantile) as NumPy's linear method gives it. Groups without values are absent."""
    margin = 2.0 / ACCURACY
    marks = [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-margin, margin)]
    about = cells.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("_min"), F.max("value").alias("_max"), F.percentile_approx("value", marks, ACCURACY).alias("_marks")
    )
    brackets = []
    for i, p in enumerate(probabilities):
        low = F.when(F.lit(p <= margin), F.col("_min")).otherwise(F.get("_marks", F.lit(2 * i)))
        high = F.when(F.lit(p >= 1 - margin), F.col("_max")).otherwise(F.get("_marks", F.lit(2 * i + 1)))
        brackets.append(F.struct(F.lit(float(p)).alias("probability"), low.alias("low"), high.alias("high")))
    bracket = about.select(group, "n", F.explode(F.array(*brackets)).alias("_b")).select(group, "n", "_b.*")
    # one row per group and probability
    placed = cells.join(F.broadcast(bracket), group)
    side = F.when(F.col("value") < F.col("low"), -1).when(F.col("value") > F.col("high"), 1).otherwise(0)
    counted = (
        placed.withColumn("_side", side)
        .groupBy(group, "probability", "n", "_side", F.when(F.col("_side") == 0, F.col("value")).alias("_inside"))
        .agg(F.count(F.lit(1)).alias("times"), F.min("value").alias("_least"), F.max("value").alias("_most"))
    )
    # a rank just outside the bracket is the greatest value below it or the least above it
    order = Window.partitionBy(group, "probability").orderBy("_side", "_inside")
    ranked = counted.withColumn("upto", F.sum("times").over(order)).withColumn("value", F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least")))
    at = F.col("probability") * (F.col("n") - 1)
    below, above = F.floor(at + 1e-9), F.ceil(at - 1e-9)
    ends = ranked.groupBy(group, "probability").agg(
        F.min(F.when(F.col("upto") > below, F.col("value"))).alias("_low"), F.min(F.when(F.col("upto") > above, F.col("value"))).alias("_high"), F.first(at - below).alias("_part")
    )
    return ends.select(group, "probability", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.greatest(F.col("_part"), F.lit(0.0))).alias("quantile"))


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, q1, median, q3)."""
    found = exact_quantiles(long_form(df, columns), (0.25, 0.5, 0.75))
    pick = lambda p: F.max(F.when(F.col("probability") == p, F.col("quantile")))
    return found.groupBy("column_name").agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))
