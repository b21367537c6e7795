"""Picture tensors as flat arrays: geometry, scaling, layout, flips, resampling, augmentation.

Element-wise steps run on the flat values of a whole Arrow batch, not per
element or per row. A null tensor stays null; a null element becomes NaN in
scaling and moves with its place in layouts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Channel mean and deviation of the pretraining set, and the input side (fixed values).
MEAN, STD, TARGET = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 224
#: Augmentation (fixed values): flip chances, rotation range in degrees, brightness and contrast range.
FLIP_LR, FLIP_TB, ROTATION, JITTER = 0.5, 0.2, 5.0, 0.1


def letterbox(width: Column, height: Column, target: int = TARGET) -> list[Column]:
    """new_width, new_height, left, top: the ratio first, then truncated sizes, then centred offsets, in this order of operations."""
    ratio = F.least(F.lit(float(target)) / width, F.lit(float(target)) / height)
    new_width, new_height = (width * ratio).cast("int"), (height * ratio).cast("int")
    return [new_width.alias("new_width"), new_height.alias("new_height"), F.floor((target - new_width) / 2).cast("int").alias("left"), F.floor((target - new_height) / 2).cast("int").alias("top")]


def _flat(batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all lists in one array, each value's place in its list, and the offsets of the lists."""
    sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    values = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values, np.arange(len(values)) - np.repeat(offsets[:-1], sizes), offsets


def _lists(values: np.ndarray, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    missing = like.is_null().to_numpy(zero_copy_only=False)
    # a list is null where its offset is
    starts = pa.array(offsets.astype(np.int32), mask=np.append(missing, False)) if missing.any() else pa.array(offsets.astype(np.int32))
    return pa.ListArray.from_arrays(starts, pa.array(values))


def _scaled(tensor: Column, change: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """``change(values, places)`` on every value of a batch at once."""

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        values, places, offsets = _flat(batch)
        return _lists(change(values, places), offsets, batch)

    return run(tensor)


def _moved(tensor: Column, source: Callable[[np.ndarray], np.ndarray]) -> Column:
    """Element ``i`` becomes the one at ``source(i)``."""

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        values, places, offsets = _flat(batch)
        return _lists(values[source(places) + (np.arange(len(values)) - places)], offsets, batch)

    return run(tensor)


def normalize(tensor: Column, plane: int, scale: float = 1.0, mean: Sequence[float] = MEAN, std: Sequence[float] = STD) -> Column:
    """(x / scale - mean) / std per channel of a C,H,W array; ``plane`` is H·W."""
    m, s = np.array(mean), np.array(std)
    return _scaled(tensor, lambda x, at: (x / scale - m[at // plane]) / s[at // plane])


def denormalize(tensor: Column, plane: int, mean: Sequence[float] = MEAN, std: Sequence[float] = STD) -> Column:
    """x · std + mean, clipped to [0, 1]."""
    m, s = np.array(mean), np.array(std)
    return _scaled(tensor, lambda x, at: np.clip(x * s[at // plane] + m[at // plane], 0.0, 1.0))


def to_bytes_scale(tensor: Column) -> Column:
    """0..1 to whole numbers 0..255, halves upwards."""
    return _scaled(tensor, lambda x, at: np.floor(x * 255 + 0.5))


def to_channels_last(tensor: Column, channels: int, plane: int) -> Column:
    """C,H,W → H,W,C."""
    return _moved(tensor, lambda i: (i % channels) * plane + i // channels)


def to_channels_first(tensor: Column, channels: int, plane: int) -> Column:
    """H,W,C → C,H,W."""
    return _moved(tensor, lambda i: (i % plane) * channels + i // plane)


def as_channels_first(tensor: Column, shape: Sequence[int]) -> Column:
    """C,H,W of a stack whose pictures have ``shape``: turned if the last dimension is 1 or 3, as it is otherwise."""
    if len(shape) != 3:
        raise ValueError(f"a picture has three dimensions, not {len(shape)}")
    return to_channels_first(tensor, shape[2], shape[0] * shape[1]) if shape[2] in (1, 3) else tensor


def flip_lr(tensor: Column, width: int) -> Column:
    return _moved(tensor, lambda i: i - 2 * (i % width) + (width - 1))


def flip_tb(tensor: Column, width: int, height: int) -> Column:
    plane = width * height
    return _moved(tensor, lambda i: i - i % plane + (height - 1 - i % plane // width) * width + i % width)


def position_sum(tensor: Column) -> Column:
    """Sum of (position · value), positions from 1: tells apart any two layouts of the same values."""

    @F.arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        if isinstance(batch, (pa.BinaryArray, pa.LargeBinaryArray)):
            sums = [float(np.dot(v := np.frombuffer(raw.as_buffer(), dtype=np.uint8).astype(np.float64), np.arange(1, len(v) + 1))) if raw.is_valid else None for raw in batch]
            return pa.array(sums, type=pa.float64())
        values, places, offsets = _flat(batch)
        running = np.concatenate([[0.0], np.cumsum(values * (places + 1))]) if len(values) > 1e6 else None
        sums = np.diff(running[offsets]) if running is not None else np.array([(values[a:b] * np.arange(1, b - a + 1)).sum() for a, b in zip(offsets[:-1], offsets[1:])])
        return pa.array(sums, mask=batch.is_null().to_numpy(zero_copy_only=False), type=pa.float64())

    return run(tensor)


# ---- pictures of uint8 values, [height, width, channels] -------------------

#: Values of the pictures worked on at once within an Arrow batch, before or after resampling, which bounds a worker's memory whatever their size.
PART_VALUES = 16 * TARGET * TARGET * 3


def _kernel(x: np.ndarray, lobes: int = 3) -> np.ndarray:
    return np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)


def _weights(source: int, target: int) -> np.ndarray:
    """[target, source] of the windowed sinc filter, widened when shrinking."""
    stretch = max(source / target, 1.0)
    centres = (np.arange(target) + 0.5) * source / target
    weights = _kernel((np.arange(source)[None, :] + 0.5 - centres[:, None]) / stretch)
    return weights / weights.sum(1, keepdims=True)


def letterbox_stack(pictures: np.ndarray, target: int = TARGET) -> np.ndarray:
    """[n, target, target, channels] of pictures of one size: resampled with three lobes, rows then columns, and pasted centred on black."""
    n, height, width, channels = pictures.shape
    ratio = min(target / width, target / height)
    new_width, new_height = max(1, int(width * ratio)), max(1, int(height * ratio))
    tall, wide = _weights(height, new_height).astype(np.float32), np.ascontiguousarray(_weights(width, new_width).astype(np.float32).T)
    out = np.zeros((n, target, target, channels), dtype=np.uint8)
    top, left = (target - new_height) // 2, (target - new_width) // 2
    for picture, boxed in zip(pictures, out):  # one by one, a picture's values stay in a core's cache
        planes = np.matmul(tall, picture.transpose(2, 0, 1).astype(np.float32))
        scaled = np.matmul(planes.reshape(channels * new_height, width), wide)
        np.rint(scaled, out=scaled)
        np.minimum(np.maximum(scaled, 0, out=scaled), 255, out=scaled)
        for channel, plane in enumerate(scaled.astype(np.uint8).reshape(channels, new_height, new_width)):
            boxed[top : top + new_height, left : left + new_width, channel] = plane
    return out


def pixels_of(normalised: np.ndarray, plane: int, mean: Sequence[float] = MEAN, std: Sequence[float] = STD) -> np.ndarray:
    """[n, plane, channels] bytes of normalised pictures [n, channels · plane]: what ``denormalize``, ``to_channels_last`` and ``to_bytes_scale`` give."""
    x = normalised.astype(np.float64).reshape(len(normalised), -1, plane)
    scaled = np.clip(x * np.array(std)[:, None] + np.array(mean)[:, None], 0.0, 1.0)
    return np.floor(scaled * 255 + 0.5).astype(np.uint8).transpose(0, 2, 1)


def rotate_stack(pictures: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Bilinear rotation of each picture about its centre by its own angle; what falls outside is black."""
    n, height, width, channels = pictures.shape
    angle = np.deg2rad(np.asarray(degrees, dtype=np.float64))[:, None, None]
    y, x = np.mgrid[0:height, 0:width] - np.array([(height - 1) / 2, (width - 1) / 2])[:, None, None]
    sx = np.cos(angle) * x - np.sin(angle) * y + (width - 1) / 2
    sy = np.sin(angle) * x + np.cos(angle) * y + (height - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros(pictures.shape)
    own = np.arange(n)[:, None, None]
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            weight = (1 - np.abs(sx - xi)) * (1 - np.abs(sy - yi))
            inside = (xi >= 0) & (xi < width) & (yi >= 0) & (yi < height)
            out += np.where(inside, weight, 0)[..., None] * pictures[own, np.clip(yi, 0, height - 1), np.clip(xi, 0, width - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def augment_stack(pictures: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flips, a small rotation, then brightness and contrast, by five draws from 0..1 for each picture."""
    pictures = np.where((draws[:, 0] < FLIP_LR)[:, None, None, None], pictures[:, :, ::-1], pictures)
    pictures = np.where((draws[:, 1] < FLIP_TB)[:, None, None, None], pictures[:, ::-1], pictures)
    within = lambda u, low, high: (low + (high - low) * u)[:, None, None, None]
    pictures = rotate_stack(pictures, ROTATION * (2 * draws[:, 2] - 1)).astype(np.float64)
    pictures = np.clip(pictures * within(draws[:, 3], 1 - JITTER, 1 + JITTER), 0, 255)
    grey = (pictures @ np.array([0.299, 0.587, 0.114])).mean((1, 2))[:, None, None, None]
    return np.clip(np.rint(grey + (pictures - grey) * within(draws[:, 4], 1 - JITTER, 1 + JITTER)), 0, 255).astype(np.uint8)


def draws_of(keys: Sequence, numbers: Sequence[int]) -> np.ndarray:
    """[n, 5] repeatable draws from 0..1, from a hash of the whole key and copy number."""
    digests = [hashlib.blake2b(f"{key!r}:{number}".encode(), digest_size=40).digest() for key, number in zip(keys, numbers)]
    return np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(len(digests), 5) / 2.0**64


def picture_step(df: DataFrame, key: str, data: str, width: str, height: str, target: int = TARGET, augment: bool = False, copy: str | None = None, normalised: bool = False, sums: bool = False) -> DataFrame:
    """(key[, copy], tensor binary): letterboxed pixels as bytes, H,W,C; with ``augment`` rows of copy > 0 are altered first, by draws keyed on the whole key and copy. Rows whose data does not fit their size are left out.

    With ``normalised`` the data are normalised values in C,H,W order and become pixels first. With ``sums`` (n_values, position_sum) come
    out in place of the tensor, which then never leaves the worker.
    """
    columns = [key, *([copy] if copy else [])]
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + (", n_values int, position_sum double" if sums else ", tensor binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            values = whole.column(data)
            w, h = (whole.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (width, height))
            fits = (w > 0) & (h > 0) & (values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == w * h * 3)
            shapes, shape_of = np.unique(np.stack([w[fits], h[fits]], axis=1), axis=0, return_inverse=True)
            for i, (own_w, own_h) in enumerate(shapes.tolist()):
                same = np.flatnonzero(fits)[shape_of.reshape(-1) == i]
                step = max(1, PART_VALUES // (max(own_w * own_h, target * target) * 3))
                yield from (part(whole.take(pa.array(same[begin : begin + step])), own_w, own_h) for begin in range(0, len(same), step))

    def part(rows: pa.RecordBatch, w: int, h: int) -> pa.RecordBatch:
        flat = rows.column(data).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        pictures = (pixels_of(flat, w * h) if normalised else flat.astype(np.uint8)).reshape(-1, h, w, 3)
        if augment:
            numbers = rows.column(copy).to_numpy(zero_copy_only=False) if copy else np.ones(len(pictures), dtype=int)
            altered = numbers > 0
            if altered.any():
                pictures = pictures.copy()
                keys = rows.column(key).filter(pa.array(altered)).to_pylist()
                pictures[altered] = augment_stack(pictures[altered], draws_of(keys, numbers[altered].tolist()))
        boxed = letterbox_stack(pictures, target).reshape(len(pictures), -1)
        if sums:
            places = np.arange(1, boxed.shape[1] + 1, dtype=np.float64)
            made = {"n_values": pa.array([boxed.shape[1]] * len(boxed), pa.int32()), "position_sum": pa.array([float(p.astype(np.float64) @ places) for p in boxed], pa.float64())}
        else:
            made = {"tensor": pa.array([p.tobytes() for p in boxed], pa.binary())}
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *made.values()], names=[*columns, *made])

    return df.select(*columns, data, width, height).mapInArrow(run, schema)
