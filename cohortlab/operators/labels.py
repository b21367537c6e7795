"""Label codes: binary map, validity gate, collapse, duplicates, pictures, unpaired pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The class codes of the pictures (fixed values): 0 chocolate cyst, 1 serous cystadenoma, 2 teratoma, 3 theca cell tumor, 4 simple cyst, 5 normal ovary, 6 mucinous cystadenoma, 7 high-grade serous cystadenocarcinoma; only 7 is malignant.
BINARY = {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1}


def binary_label(code: Column) -> Column:
    """0 or 1; null for a missing or undefined code."""
    return F.when(code == 7, 1).when(code.between(0, 6), 0)


def stem(path: Column) -> Column:
    """Lower-cased base name without its last suffix; a leading full stop is no suffix."""
    base = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_replace(base, r"(?s)(?<=.)\.[^.]*+\z", ""))


def valid_lists(labels: DataFrame, list_id: str, code: str) -> DataFrame:
    """Rows of the lists without any missing or undefined code: one bad code rejects its whole list."""
    bad = labels.where(binary_label(F.col(code)).isNull()).select(list_id).distinct()
    return labels.join(bad, list_id, "left_anti")


def collapse(labels: DataFrame, code: str, name: str = "collapsed") -> DataFrame:
    """If any code exceeds 1 the label is (code = 7), else the code itself."""
    most = labels.agg(F.max(code).alias("_most"))
    return labels.crossJoin(F.broadcast(most)).withColumn(name, F.when(F.col("_most") > 1, (F.col(code) == 7).cast("long")).otherwise(F.col(code).cast("long"))).drop("_most")


def last_per_key(labels: DataFrame, key: Column, order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the last by ``order``. Partial aggregation, no sort."""
    return labels.groupBy(key.alias("stem")).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_last")).select("stem", "_last.*")


def label_images(labels: DataFrame, images: DataFrame, order: list[str]) -> DataFrame:
    """Labels joined with the pictures of the same stem; labels without picture and pictures without label fall away. Of pictures that share a stem the last by ``order`` counts."""
    others = [c for c in images.columns if c != "stem"]
    return labels.join(images.groupBy("stem").agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last")).select("stem", *[F.col(f"_last.`{c}`") for c in others]), "stem")


def cyclic_pairs(first: DataFrame, second: DataFrame, seed: int = 42, first_index: str = "idx", second_index: str = "idx") -> DataFrame:
    """Unpaired pairing of two tables with contiguous indices 0..n-1.

    As many pairs as the longer table has rows: pair i takes row i mod n of the
    first, and a row of the second drawn with replacement by 60 bits of a keyed hash.
    """
    spark = first.sparkSession
    n1, n2 = (t.agg(F.count(F.lit(1))).first()[0] for t in (first, second))
    if not n1 or not n2:
        ids = spark.range(0)
    else:
        ids = spark.range(max(n1, n2))
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    pairs = ids.select(F.col("id").alias("pair"), (F.col("id") % max(n1, 1)).alias("_i"), (chance % max(n2, 1)).alias("_j"))
    a = first.withColumnRenamed(first_index, "_i")
    b = second.withColumnRenamed(second_index, "_j")
    return pairs.join(a, "_i").join(b, "_j").withColumnsRenamed({"_i": "first_index", "_j": "second_index"})
