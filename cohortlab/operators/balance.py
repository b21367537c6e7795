"""Class counts, loss weights and replication of the rare class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Factors on negatives/positives (fixed values): two for the convolutional and the transformer head, one for their hybrid, 2.5 and 3 for the fused models.
POS_WEIGHT_FACTORS = {"resnet": 2.0, "vit": 2.0, "hybrid": 1.0, "late_fusion": 2.5, "shared_backbone": 3.0, "boosted_trees": 1.0}
#: Whose classes are counted for a model's weight; the pictures' where none is named.
POS_WEIGHT_COUNTS = {"shared_backbone": ("image", "clinical"), "boosted_trees": ("clinical",)}
#: Extra copies of a malignant training picture (fixed value).
COPIES = 24


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives, positives, missing, and positives per negative rounded to two places (null without negatives)."""
    counts = df.agg(F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label).isNull()).alias("missing"))
    return counts.withColumn("ratio", F.round(F.try_divide("positives", "negatives"), 2))


def pos_weights(images: DataFrame, image_label: str, clinical: DataFrame, clinical_label: str) -> DataFrame:
    """(model, pos_weight): factor · negatives / positives, null without positives. The shared model counts both tables, boosted trees the clinical one, all others the pictures."""
    counted = {name: class_balance(df, label).select(F.struct("negatives", "positives").alias(name)) for name, df, label in (("image", images, image_label), ("clinical", clinical, clinical_label))}
    lines = []
    for model, factor in POS_WEIGHT_FACTORS.items():
        tables = POS_WEIGHT_COUNTS.get(model, ("image",))
        negatives, positives = (sum(F.col(f"{t}.{side}") for t in tables) for side in ("negatives", "positives"))
        lines.append(F.struct(F.lit(model).alias("model"), (F.lit(factor) * F.try_divide(negatives, positives)).alias("pos_weight")))
    return counted["image"].crossJoin(counted["clinical"]).select(F.explode(F.array(*lines)).alias("_m")).select("_m.*")  # one row beside one row


def augment_expand(df: DataFrame, label: str, copies: int = COPIES, name: str = "copy") -> DataFrame:
    """The original (copy 0) and, where the label is 1, ``copies`` further rows; a narrow explode."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.when(F.col(label) == 1, copies).otherwise(0))))
