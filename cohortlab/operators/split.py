"""Splits, samples and batches from keyed hashes: the same rows after any retry, in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, key: Column) -> Column:
    """A pseudo-random order key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ordered_positions(df: DataFrame, by: Column, name: str, group: list[str] | None = None) -> DataFrame:
    """Number rows 0, 1, ... in the order of a hexadecimal hash, without one task holding all: the first three digits are buckets with counted offsets."""
    group = group or []
    keyed = df.withColumn("_by", by).withColumn("_bucket", F.substring("_by", 1, 3))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # at most 4096 rows per group
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_bucket").orderBy("_by")
    return keyed.withColumn("_rn", F.row_number().over(inside) - 1).join(before, [*group, "_bucket"]).withColumn(name, F.col("_rn") + F.col("_before")).drop("_by", "_bucket", "_rn", "_before")


def quotas(counts: DataFrame, label: str, share: float = 0.2) -> DataFrame:
    """(label, quota): ceil(share·n) test rows in all, given to the classes by largest remainder; ties to the smaller label. ``counts`` has label and n."""
    total = counts.agg(F.sum("n").alias("_all"))
    exact = counts.crossJoin(F.broadcast(total)).withColumn("_exact", F.ceil(F.col("_all") * share) * F.col("n") / F.col("_all"))
    floors = exact.withColumn("_floor", F.floor("_exact"))
    everything = Window.partitionBy(F.lit(0))  # a row per class
    left = floors.withColumn("_left", F.ceil(F.col("_all") * share) - F.sum("_floor").over(everything))
    rank = F.row_number().over(everything.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), label))
    return left.select(label, "n", (F.col("_floor") + (rank <= F.col("_left")).cast("long")).alias("quota"))


def split_stratified(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``set``: 'test' for the quota of each class, 'train' for the rest."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    placed = ordered_positions(df, draw(seed, F.col(key)), "_position", [label])
    return placed.join(quotas(counts, label, share).select(label, "quota"), label).withColumn("set", F.when(F.col("_position") < F.col("quota"), "test").otherwise("train")).drop("_position", "quota")


def batch_assign(df: DataFrame, key: str, size: int, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """Add ``batch`` and ``slot`` for a shuffled epoch; ``drop_last`` leaves out a short last batch."""
    placed = ordered_positions(df, draw(epoch, F.col(key)), "_position").withColumn("batch", F.floor(F.col("_position") / size)).withColumn("slot", F.col("_position") % size)
    if drop_last:
        full = df.agg(F.floor(F.count(F.lit(1)) / size).alias("_full"))
        placed = placed.crossJoin(F.broadcast(full)).where(F.col("batch") < F.col("_full")).drop("_full")
    return placed.drop("_position")


def sample_random(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n random rows without replacement, all if there are fewer. A top-n by hash: every task keeps n rows."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)


def sample_head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(n)
