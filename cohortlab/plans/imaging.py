"""Queries of picture tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import balance, split, tensor
from cohortlab.operators.tensor import position_sum
from cohortlab.plans.common import read, rounded

CHANNELS, SIDE = 3, 16
PLANE = SIDE * SIDE


def _images(spark, folder):
    return read(spark, folder, "train_augmented2_data").where(F.size("images") == CHANNELS * PLANE).select("sample_id", "aug_k", "labels", "images")


def letterbox_geometry(spark, folder):
    sizes = read(spark, folder, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 2999 + 1).alias("width"), (F.col("p_partkey") * 104729 % 2999 + 1).alias("height"))
    return sizes.select("p_partkey", "width", "height", *tensor.letterbox(F.col("width"), F.col("height")))


def tensor_denormalize(spark, folder):
    return rounded(_images(spark, folder).select("sample_id", tensor.denormalize(F.col("images"), PLANE).alias("t")).select("sample_id", position_sum(F.col("t")).alias("position_sum")), 4)


def tensor_normalize(spark, folder):
    pixels = _images(spark, folder).select("sample_id", tensor.to_bytes_scale(tensor.denormalize(F.col("images"), PLANE)).alias("t"))
    return rounded(pixels.select("sample_id", tensor.normalize(F.col("t"), PLANE, 255.0).alias("t")).select("sample_id", position_sum(F.col("t")).alias("position_sum")), 4)


def tensor_permute(spark, folder):
    turned = _images(spark, folder).select("sample_id", tensor.to_channels_last(F.col("images"), CHANNELS, PLANE).alias("t"))
    back = turned.select("sample_id", "t", tensor.as_channels_first(F.col("t"), (SIDE, SIDE, CHANNELS)).alias("b"))
    return rounded(back.select("sample_id", position_sum(F.col("t")).alias("channels_last"), position_sum(F.col("b")).alias("channels_first")), 4)


def augment_flip(spark, folder):
    flipped = _images(spark, folder).select("sample_id", tensor.flip_lr(F.col("images"), SIDE).alias("l"), tensor.flip_tb(F.col("images"), SIDE, SIDE).alias("t"))
    return rounded(flipped.select("sample_id", position_sum(F.col("l")).alias("left_right"), position_sum(F.col("t")).alias("top_bottom")), 4)


def sample_grid(spark, folder):
    """Ten random pictures as they would be shown: denormalised."""
    few = split.sample_random(_images(spark, folder), "sample_id", 10)
    return rounded(few.select("sample_id", "labels", tensor.denormalize(F.col("images"), PLANE).alias("t")).select("sample_id", "labels", position_sum(F.col("t")).alias("position_sum")), 4)


def _sized(images):
    return images.select("sample_id", "labels", "images", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))


def image_letterbox(spark, folder):
    return tensor.picture_step(_sized(_images(spark, folder)), "sample_id", "images", "width", "height", normalised=True, sums=True)


def image_augment(spark, folder):
    """24 altered copies of every malignant original. Rows of ``aug_k`` > 0 are such copies already and not copied again."""
    copies = balance.augment_expand(_sized(_images(spark, folder).where("aug_k = 0")), "labels")
    return tensor.picture_step(copies, "sample_id", "images", "width", "height", augment=True, copy="copy", normalised=True, sums=True)


QUERIES = {f.__name__: f for f in (letterbox_geometry, tensor_denormalize, tensor_normalize, tensor_permute, augment_flip, sample_grid, image_letterbox, image_augment)}

_I = "with i as (select sample_id, images::double[] as x from train_augmented2_data where len(images) = 768)"
_MEAN = "[0.485, 0.456, 0.406]::double[]"
_STD = "[0.229, 0.224, 0.225]::double[]"
_DENORM = f"list_transform(x, lambda v, k: least(greatest(v * ({_STD})[(k - 1) // 256 + 1] + ({_MEAN})[(k - 1) // 256 + 1], 0), 1))"


def _sum(array: str) -> str:
    return f"round(list_sum(list_transform({array}, lambda v, k: v * k)), 4)"


ORACLES = {
    "letterbox_geometry": """
        with s as (select p_partkey, p_partkey * 7919 % 2999 + 1 as width, p_partkey * 104729 % 2999 + 1 as height from part),
        r as (select *, least(224::double / width, 224::double / height) as r from s),
        n as (select *, trunc(width * r)::int as nw, trunc(height * r)::int as nh from r)
        select p_partkey, width, height, nw as new_width, nh as new_height, ((224 - nw) // 2)::int as "left", ((224 - nh) // 2)::int as top from n""",
    "sample_grid": f"with i as (select sample_id, labels, images::double[] as x from train_augmented2_data where len(images) = 768 order by md5('42:' || sample_id), sample_id limit 10) select sample_id, labels, {_sum(_DENORM)} as position_sum from i",
    "tensor_denormalize": f"{_I} select sample_id, {_sum(_DENORM)} as position_sum from i",
    "tensor_normalize": f"{_I}, p as (select sample_id, list_transform({_DENORM}, lambda v: round(v * 255)) as x from i), q as (select sample_id, list_transform(x, lambda v, k: (v / 255 - ({_MEAN})[(k - 1) // 256 + 1]) / ({_STD})[(k - 1) // 256 + 1]) as x from p) select sample_id, {_sum('x')} as position_sum from q",
    "tensor_permute": f"{_I} select sample_id, {_sum('list_transform(range(768), lambda j: x[(j % 3) * 256 + j // 3 + 1])')} as channels_last, {_sum('x')} as channels_first from i",
    "augment_flip": f"{_I} select sample_id, {_sum('list_transform(range(768), lambda j: x[j - 2 * (j % 16) + 15 + 1])')} as left_right, {_sum('list_transform(range(768), lambda j: x[j - j % 256 + (15 - (j % 256) // 16) * 16 + j % 16 + 1])')} as top_bottom from i",
}
