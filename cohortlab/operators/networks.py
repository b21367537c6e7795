"""Training of the two-modality networks on frozen features, spread over shards of rows.

Every epoch each shard of at most ``SHARD_ROWS`` rows runs through mini-batches with
Adam from the same weights; the shards' weights are then averaged, weighted by
rows, first in groups and then over the groups, so that the driver gets
``FAN`` models at most. With one shard this is plain mini-batch training, but for
Adam's moments, which start anew each epoch.

Defined results: rows with a missing or unusable feature or label are left out;
a batch of fewer than ``BATCH`` rows is dropped unless the shard has no other; no
rows leave the initial weights; equal input gives equal weights.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import materialize

#: Settings of the training loops (fixed values).
EPOCHS, BATCH, STEP, DECAY = 5, 64, 5e-5, 0.01
#: Rows a shard holds at most, and models averaged at once.
SHARD_ROWS, FAN = 200_000, 16
#: Weights that an Adam step works on at once.
ADAM_BLOCK = 16_384

Weights = dict[str, np.ndarray]


def initial(widths: dict[str, tuple[int, int]], seed: int = 42) -> Weights:
    """Weights and biases of layers (outputs, inputs), uniform within 1 / sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, (outputs, inputs) in widths.items():
        bound = 1 / np.sqrt(inputs)
        out[f"{name}.w"] = rng.uniform(-bound, bound, (outputs, inputs)).astype(np.float32)
        out[f"{name}.b"] = rng.uniform(-bound, bound, outputs).astype(np.float32)
    return out


def trainable(weights: Weights, frozen: Sequence[str] = ()) -> list[str]:
    """Names of the parameters that are trained: all but those of frozen layers, an unknown one of which is an error."""
    layers = {name.rsplit(".", 1)[0] for name in weights}
    if unknown := set(frozen) - layers:
        raise ValueError(f"unknown layers: {sorted(unknown)}")
    return [name for name in weights if name.rsplit(".", 1)[0] not in frozen]


class Pass:
    """One forward pass that remembers what the backward pass needs."""

    def __init__(self, weights: Weights) -> None:
        self.weights, self.grads = weights, {}

    def run(self, x: np.ndarray, names: Sequence[str]) -> tuple[np.ndarray, list]:
        """Layers with ReLU after each; (output, memory)."""
        memory = []
        for name in names:
            z = x @ self.weights[f"{name}.w"].T + self.weights[f"{name}.b"]
            memory.append((name, x, z > 0))
            x = np.maximum(z, 0)
        return x, memory

    def back(self, grad: np.ndarray, memory: list) -> np.ndarray:
        for name, x, open_ in reversed(memory):
            grad = grad * open_
            grad = self.linear_back(grad, name, x)
        return grad

    def linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.weights[f"{name}.w"].T + self.weights[f"{name}.b"]

    def linear_back(self, grad: np.ndarray, name: str, x: np.ndarray) -> np.ndarray:
        for part, value in (("w", grad.T @ x), ("b", grad.sum(0))):
            if (known := self.grads.get(f"{name}.{part}")) is None:
                self.grads[f"{name}.{part}"] = value
            else:
                known += value
        return grad @ self.weights[f"{name}.w"]


def bce_grad(z: np.ndarray, y: np.ndarray, pos_weight: float) -> np.ndarray:
    """Gradient of the mean weighted cross-entropy of logits z [n, 1]."""
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    y = y.reshape(z.shape)
    return (p * (1 - y) - pos_weight * y * (1 - p)).astype(np.float32) / len(z)


class SharedBackbone:
    """A projection of image features and an encoder of clinical ones into a backbone and a classifier that both share."""

    def __init__(self, image: int, clinical: int, encoder: Sequence[int], projection: int, backbone: Sequence[int]) -> None:
        sizes = {"project": (projection, image)}
        before = clinical
        for i, width in enumerate(encoder):
            sizes[f"encode{i}"], before = (width, before), width
        before = encoder[-1]
        for i, width in enumerate(backbone):
            sizes[f"share{i}"], before = (width, before), width
        sizes["classify"] = (1, before)
        self.sizes, self.encode, self.share = sizes, [f"encode{i}" for i in range(len(encoder))], [f"share{i}" for i in range(len(backbone))]

    def logits(self, weights: Weights, image: np.ndarray | None, clinical: np.ndarray | None) -> dict[str, np.ndarray]:
        run = Pass(weights)
        parts = {"image": (image, ["project"]), "clinical": (clinical, self.encode)}
        return {name: run.linear(run.run(x, [*own, *self.share])[0], "classify") for name, (x, own) in parts.items() if x is not None}

    def gradients(self, weights: Weights, image: np.ndarray, clinical: np.ndarray, y_image: np.ndarray, y_clinical: np.ndarray, pos_weight: float) -> Weights:
        run = Pass(weights)
        for x, y, own in ((image, y_image, ["project"]), (clinical, y_clinical, self.encode)):
            h, memory = run.run(x, [*own, *self.share])
            run.back(run.linear_back(bce_grad(run.linear(h, "classify"), y, pos_weight), "classify", h), memory)
        return run.grads


class LateFusion:
    """A head on image features, a clinical branch with a head, and a fusion layer with a head on both."""

    def __init__(self, image: int, clinical: int, branch: Sequence[int], fusion: int) -> None:
        sizes, before = {"image_head": (1, image)}, clinical
        for i, width in enumerate(branch):
            sizes[f"branch{i}"], before = (width, before), width
        sizes |= {"clinical_head": (1, before), "fuse": (fusion, image + before), "fusion_head": (1, fusion)}
        self.sizes, self.branch = sizes, [f"branch{i}" for i in range(len(branch))]

    def logits(self, weights: Weights, image: np.ndarray, clinical: np.ndarray) -> dict[str, np.ndarray]:
        run = Pass(weights)
        c, _ = run.run(clinical, self.branch)
        joined, _ = run.run(np.concatenate([image, c], axis=1), ["fuse"])
        return {"image": run.linear(image, "image_head"), "clinical": run.linear(c, "clinical_head"), "fusion": run.linear(joined, "fusion_head")}

    def gradients(self, weights: Weights, image: np.ndarray, clinical: np.ndarray, y_image: np.ndarray, y_clinical: np.ndarray, pos_weight: float) -> Weights:
        run = Pass(weights)
        c, memory = run.run(clinical, self.branch)
        both = np.concatenate([image, c], axis=1)
        joined, fused = run.run(both, ["fuse"])
        run.linear_back(bce_grad(run.linear(image, "image_head"), y_image, pos_weight), "image_head", image)
        back_c = run.linear_back(bce_grad(run.linear(c, "clinical_head"), y_clinical, pos_weight), "clinical_head", c)
        back = run.back(run.linear_back(bce_grad(run.linear(joined, "fusion_head"), y_image, pos_weight), "fusion_head", joined), fused)
        run.back(back_c + back[:, image.shape[1] :], memory)
        return run.grads


def _epoch(network, weights: Weights, arrays: Sequence[np.ndarray], pos_weight: float, rng: np.random.Generator, step: float, trained: Sequence[str]) -> Weights:
    """Mini-batches with Adam and weight decay over the rows in random order."""
    weights = {k: v.copy() for k, v in weights.items()}
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    n = len(arrays[0])
    order = rng.permutation(n)
    for t, begin in enumerate(range(0, max(n - BATCH + 1, 1) if n else 0, BATCH), start=1):
        at = order[begin : begin + BATCH]
        grads = network.gradients(weights, *(a[at] for a in arrays), pos_weight)
        for k in trained:
            _adam(*(x.reshape(-1) for x in (weights[k], grads[k], first[k], second[k])), step, t)
    return weights


def _adam(weights: np.ndarray, grads: np.ndarray, first: np.ndarray, second: np.ndarray, step: float, t: int) -> None:
    """A step in place, in blocks that stay in a core's cache: the widest layers have half a million weights."""
    for begin in range(0, len(weights), ADAM_BLOCK):
        w, g, m, v = (x[begin : begin + ADAM_BLOCK] for x in (weights, grads, first, second))
        g += DECAY * w
        m += 0.1 * (g - m)
        g *= g
        g -= v
        g *= 0.001
        v += g
        moved = m / (1 - 0.9**t)
        moved *= step
        scale = v / (1 - 0.999**t)
        np.sqrt(scale, out=scale)
        scale += 1e-8
        moved /= scale
        w -= moved


def _flat(weights: Weights) -> bytes:
    return np.concatenate([v.ravel() for v in weights.values()]).astype(np.float32).tobytes()


def _shaped(flat: bytes, like: Weights) -> Weights:
    values, out, at = np.frombuffer(flat, dtype=np.float32), {}, 0
    for k, v in like.items():
        out[k] = values[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def _average(frame: pd.DataFrame) -> pd.DataFrame:
    total = frame["n"].sum()
    mean = np.zeros(len(frame["weights"].iloc[0]) // 4)
    for flat, n in zip(frame["weights"], frame["n"]):
        mean += np.frombuffer(flat, dtype=np.float32) * (n / max(total, 1))
    return pd.DataFrame({"part": [0], "n": [total], "weights": [mean.astype(np.float32).tobytes()]})


def train(rows: DataFrame, network, key: str, image: str, clinical: str, y_image: str, y_clinical: str, pos_weight: float, epochs: int = EPOCHS, step: float = STEP, seed: int = 42, frozen: Sequence[str] = ()) -> Weights:
    """Train on paired rows; each shard's result is a row of flat weights, averaged in two steps. Layers named in ``frozen`` keep their weights."""
    spark = rows.sparkSession
    weights = initial(network.sizes, seed)
    trained = trainable(weights, frozen)
    known = rows.select(key, *[F.transform(F.col(c), lambda x: x.cast("double")).alias(c) for c in (image, clinical)], y_image, y_clinical).dropna()
    known = materialize(known.where(~F.exists(image, lambda x: x.isNull() | F.isnan(x)) & ~F.exists(clinical, lambda x: x.isNull() | F.isnan(x))), "training-rows")
    n = known.count()
    shards = max(1, -(-n // SHARD_ROWS))
    sharded = known.withColumn("_shard", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(shards)).cast("int"))

    def one_epoch(shared, epoch: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(key, kind="stable")
            arrays = [np.stack(frame[c].to_numpy()).astype(np.float32) for c in (image, clinical)] + [frame[c].to_numpy(np.float32) for c in (y_image, y_clinical)]
            shard = int(frame["_shard"].iloc[0])
            moved = _epoch(network, shared.value, arrays, pos_weight, np.random.default_rng([seed, epoch, shard]), step, trained)
            return pd.DataFrame({"part": [shard % FAN], "n": [len(frame)], "weights": [_flat(moved)]})

        return run

    schema = "part int, n long, weights binary"
    for epoch in range(epochs if n else 0):
        shared = spark.sparkContext.broadcast(weights)  # the model, whose size the data do not change
        moved = sharded.groupBy("_shard").applyInPandas(one_epoch(shared, epoch), schema).groupBy("part").applyInPandas(_average, schema)
        weights = _shaped(_average(moved.toPandas())["weights"].iloc[0], weights)  # FAN models at most
    return weights


def scored(rows: DataFrame, network, weights: Weights, image: str | None, clinical: str | None, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and p_<head> of every head the given modalities reach."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    used = [c for c in (image, clinical) if c]
    heads = list(network.logits(weights, *(np.zeros((1, s[1]), dtype=np.float32) if c else None for c, s in zip((image, clinical), _inputs(network)))))
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"p_{h} double" for h in heads])

    def run(batches):
        for frame in batches:
            if len(frame):
                parts = [np.stack(frame[c].to_numpy()).astype(np.float32) if c else None for c in (image, clinical)]
                z = network.logits(shared.value, *parts)
                yield frame[list(keep)].assign(**{f"p_{h}": 1 / (1 + np.exp(-z[h][:, 0].astype(np.float64))) for h in heads})

    return rows.select(*keep, *used).mapInPandas(run, schema)


def _inputs(network) -> tuple[tuple[int, int], tuple[int, int]]:
    """(outputs, inputs) of the first layer of the image and of the clinical side."""
    sizes = network.sizes
    image = sizes.get("project") or sizes["image_head"]
    return image, sizes.get("encode0") or sizes["branch0"]
