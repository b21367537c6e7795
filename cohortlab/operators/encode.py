"""Encoding: one-hot without the first level, standardisation fit on the training rows, feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.session import materialize

#: Up to so many levels a row's value is compared with each of them; beyond, it is looked up by a shuffled join.
DENSE_LEVELS = 1000


def _distinct_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("level")) for c in columns])
    return df.select(F.explode(cells).alias("_c")).select("_c.*").where("level is not null").distinct()


def level_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column the sorted levels without the first."""
    per_column = _distinct_levels(df, columns).groupBy("column_name").agg(F.array_sort(F.collect_list("level")).alias("levels"))
    none = F.array().cast("array<string>")
    pick = lambda c: F.coalesce(F.max(F.when(F.col("column_name") == c, F.slice("levels", 2, 2**31 - 1))), none)
    return per_column.agg(*[pick(c).alias(c) for c in columns]).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_levels"))


def level_positions(df: DataFrame, column: str) -> DataFrame:
    """(level, position): 0 for the first level in sorted order, which has no dummy. Any number of levels."""
    ordered = _distinct_levels(df, [column]).select("level", F.substring("level", 1, 2).alias("_start"))
    counts = ordered.groupBy("_start").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_start").orderBy("level")
    return ordered.withColumn("_rn", F.row_number().over(inside) - 1).join(before, "_start").select("level", (F.col("_rn") + F.col("_before")).alias("position"))


def onehot_positions(df: DataFrame, column: str, name: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``name``: the dummy's position from 1, 0 for the first level, null for null and unseen ones. The sparse form for columns of very many levels; levels are joined by shuffle."""
    known = level_positions(fit_on if fit_on is not None else df, column).withColumnsRenamed({"level": "_level", "position": name})
    return df.drop(name).join(known, F.col(f"`{column}`").cast("string") == F.col("_level"), "left").drop("_level")


def onehot_drop_first(df: DataFrame, columns: Sequence[str], name: str = "onehot", fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``name`` (array of 0/1 over column_level in sorted order) and ``name``_names. Null and unseen levels are all zeros.

    There is no limit to the number of levels, but a row's array is as long as
    they are many: see ``onehot_positions`` for columns of very many levels.
    """
    fitted = fit_on if fit_on is not None else df
    levels = materialize(level_table(fitted, columns), "levels")  # one row
    sizes = levels.select(*[F.size(F.col(f"_levels.`{c}`")).alias(c) for c in columns]).first()
    looked_up = [c for c in columns if sizes[c] > DENSE_LEVELS]
    for c in looked_up:
        df = onehot_positions(df, c, f"_at_{c}", fitted)
    out = df.crossJoin(levels)

    def flags(c):
        if c in looked_up:
            return F.transform(F.sequence(F.lit(1), F.lit(sizes[c])), lambda i: F.coalesce((i == F.col(f"`_at_{c}`")).cast("int"), F.lit(0)))
        return F.transform(F.col(f"_levels.`{c}`"), lambda level: F.coalesce((F.col(f"`{c}`").cast("string") == level).cast("int"), F.lit(0)))

    def titles(c):
        return F.transform(F.col(f"_levels.`{c}`"), lambda level: F.concat(F.lit(f"{c}_"), level))

    hot, names = [flags(c) for c in columns], [titles(c) for c in columns]
    return out.withColumns({name: F.concat(*hot), f"{name}_names": F.concat(*names)}).drop("_levels", *[f"_at_{c}" for c in looked_up])


def standardize_fit(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column, NaN and null left out; a deviation of 0 counts as 1."""
    def real(c):
        return F.nullif(F.col(f"`{c}`"), F.lit(float("nan")))

    spread = lambda c: F.coalesce(F.nullif(F.stddev_pop(real(c)), F.lit(0.0)), F.lit(1.0))
    return train.agg(F.struct(*[F.struct(F.avg(real(c)).alias("mean"), spread(c).alias("spread")).alias(c) for c in columns]).alias("_scaler"))


def standardize(df: DataFrame, columns: Sequence[str], scaler: DataFrame) -> DataFrame:
    out = df.crossJoin(F.broadcast(scaler))
    scaled = {c: (F.nullif(F.col(f"`{c}`"), F.lit(float("nan"))) - F.col(f"_scaler.`{c}`.mean")) / F.col(f"_scaler.`{c}`.spread") for c in columns}
    return out.withColumns(scaled).drop("_scaler")


def feature_vector(numeric: Sequence[str], passthrough: Sequence[str], onehot: str | None = None):
    """Numerics, then passthrough integers, then dummies, as one array<double>; missing stays null inside."""
    parts = [F.array(*[F.col(f"`{c}`").cast("double") for c in (*numeric, *passthrough)])]
    if onehot:
        parts.append(F.transform(F.col(onehot), lambda x: x.cast("double")))
    return F.concat(*parts)
