"""Descriptive reports of a table: statistics, missing values, box plots, column kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.operators.quantiles import long_form, quartiles

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def dtype_routes(df: DataFrame) -> dict[str, str]:
    """Where each column goes by declared type: double → numerical (capped, scaled); string → categorical (one-hot); long, int, short, byte → passthrough; others → dropped."""
    kinds = {T.DoubleType: "numerical", T.StringType: "categorical", T.LongType: "passthrough", T.IntegerType: "passthrough", T.ShortType: "passthrough", T.ByteType: "passthrough"}
    return {f.name: kinds.get(type(f.dataType), "dropped") for f in df.schema.fields}


def dtype_routing(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, route)."""
    rows = [(i, name, route) for i, (name, route) in enumerate(dtype_routes(df).items())]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, route string")


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per numeric column: count, mean, sample deviation, minimum, quartiles, maximum. NaN counts as missing."""
    columns = list(columns or numeric_columns(df))
    basic = long_form(df, columns).groupBy("column_name").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return basic.join(quartiles(df, columns), "column_name").select("column_name", "n", "mean", "std", "low", "q1", "median", "q3", "high")


def _missing(field: T.StructField) -> F.Column:
    column = F.col(f"`{field.name}`")
    return column.isNull() | F.isnan(column) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else column.isNull()


def missing_report(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """(column_name, missing_count, missing_pct), most missing first, ties by name; one scan."""
    counts = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.count_if(_missing(f)).alias("missing_count")) for f in df.schema.fields])
    out = df.agg(F.count(F.lit(1)).alias("_n"), counts.alias("_c")).select("_n", F.explode("_c").alias("_e"))
    out = out.select("_e.column_name", "_e.missing_count", (100 * F.try_divide(F.col("_e.missing_count"), F.col("_n"))).alias("missing_pct"))
    return (out.where("missing_count > 0") if only_missing else out).orderBy(F.desc("missing_count"), "column_name")


def schema_report(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, kind, non_null) of every column; NaN counts as missing. One scan."""
    counts = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("kind"), F.count_if(~_missing(f)).alias("non_null")) for i, f in enumerate(df.schema.fields)])
    return df.agg(counts.alias("_c")).select(F.explode("_c").alias("_e")).select("_e.*")


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """(column_name, q1, q3, low, high): the fences q1 - factor·IQR and q3 + factor·IQR."""
    spread = F.col("q3") - F.col("q1")
    return quartiles(df, columns).select("column_name", "q1", "q3", (F.col("q1") - factor * spread).alias("low"), (F.col("q3") + factor * spread).alias("high"))


def boxplot_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Five numbers, the whiskers (outermost values inside the fences) and the number of outliers of each column."""
    fenced = quartiles(df, columns).withColumn("_w", 1.5 * (F.col("q3") - F.col("q1")))
    fenced = fenced.select("column_name", "q1", "median", "q3", (F.col("q1") - F.col("_w")).alias("fence_low"), (F.col("q3") + F.col("_w")).alias("fence_high"))
    inside = F.col("value").between(F.col("fence_low"), F.col("fence_high"))
    # a row per column
    return (
        long_form(df, columns)
        .join(F.broadcast(fenced), "column_name")
        .groupBy("column_name", "q1", "median", "q3")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
    )
