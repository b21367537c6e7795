"""Losses of logits as column expressions, and the epoch means of the two training loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce(z: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """Binary cross-entropy of a logit, positives weighted."""
    w = F.lit(float(pos_weight)) if isinstance(pos_weight, (int, float)) else pos_weight
    return w * y * softplus(-z) + (1 - y) * softplus(z)


def focal(z: Column, y: Column, alpha: float = 0.75, gamma: float = 2.0) -> Column:
    loss = bce(z, y)
    return F.lit(alpha) * F.pow(1 - F.exp(-loss), F.lit(gamma)) * loss


def composite(image: Column, clinical: Column, fusion: Column | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    total = F.lit(weights[0]) * image + F.lit(weights[1]) * clinical
    return total if fusion is None else total + F.lit(weights[2]) * fusion


def epoch_weighted(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """One row: batch means weighted by batch size, which is the mean over rows; and the number of batches."""
    per = df.groupBy(batch).agg(F.avg(loss).alias("_mean"), F.count(loss).alias("_n"))
    return per.agg(F.try_divide(F.sum(F.col("_mean") * F.col("_n")), F.sum("_n")).alias("epoch_loss"), F.count(F.lit(1)).alias("batches"))


def epoch_batch_mean(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """One row: the plain mean of batch means; a short last batch counts as much as a full one."""
    per = df.groupBy(batch).agg(F.avg(loss).alias("_mean"))
    return per.agg(F.avg("_mean").alias("epoch_loss"), F.count(F.lit(1)).alias("batches"))
