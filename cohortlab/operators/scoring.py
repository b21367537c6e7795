"""Forward passes of the classifiers with given weights.

A linear head is a column expression. Wider networks run as Arrow-batched
matrix products: the weights travel once per task, rows stay in batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of the networks (fixed values): clinical branch and fusion layer of the late fusion; clinical encoder, image projection and backbone of the shared model.
LATE_FUSION = {"clinical": (256, 128), "fusion": 512, "image": 2048}
SHARED = {"clinical": (1024, 512, 512), "image": (2048, 512), "backbone": (256, 128)}
#: The heads of the single models: features, hidden layer, logit (fixed values).
HEADS = {"resnet": (2048, 512, 1), "vit": (768, 512, 1)}
#: The hybrid: picture tokens, their width, the model's, heads, feed-forward width, layers (fixed values).
HYBRID = {"tokens": 49, "features": 2048, "model": 512, "heads": 8, "forward": 1024, "layers": 2}

Layer = tuple[np.ndarray, np.ndarray]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda total, x: total + x)


def linear(features: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    return dot(features, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def formula_weights(outputs: int, inputs: int, phase: int = 0) -> Layer:
    """Repeatable stand-in weights: sin(phase + j·inputs + i + 1) / sqrt(inputs), bias sin(phase + j + 1) / 10."""
    at = np.arange(outputs)[:, None] * inputs + np.arange(inputs)[None, :] + 1 + phase
    return np.sin(at) / np.sqrt(inputs), np.sin(np.arange(outputs) + 1 + phase) / 10


def parameter_count(layers: Sequence[Layer]) -> int:
    """Weights and biases of a network."""
    return sum(weights.size + bias.size for weights, bias in layers)


def network(layers: Sequence[Layer], relu_last: bool):
    """x → the layers with ReLU between them; dropout is the identity when scoring."""

    def run(x: np.ndarray) -> np.ndarray:
        for i, (weights, bias) in enumerate(layers):
            x = x @ weights.T + bias
            if relu_last or i < len(layers) - 1:
                x = np.maximum(x, 0)
        return x

    return run


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def late_fusion(image: Column, clinical: Column, clinical_layers: Sequence[Layer], image_head: Layer, clinical_head: Layer, fusion: Layer, fusion_head: Layer) -> Column:
    """struct(image_logit, clinical_logit, fusion_logit): a head per modality, and one on the ReLU of the joined features."""
    encode = network(clinical_layers, relu_last=True)

    @F.pandas_udf("image_logit double, clinical_logit double, fusion_logit double")
    def forward(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            x, c = _matrix(left), encode(_matrix(right))
            joined = np.maximum(np.concatenate([x, c], axis=1) @ fusion[0].T + fusion[1], 0)
            heads = ((x, image_head), (c, clinical_head), (joined, fusion_head))
            yield pd.DataFrame({name: (v @ w.T + b)[:, 0] for name, (v, (w, b)) in zip(("image_logit", "clinical_logit", "fusion_logit"), heads)})

    return forward(image, clinical)


def shared_backbone(features: Column, encoder: Sequence[Layer], backbone: Sequence[Layer], head: Layer) -> Column:
    """The logit of one modality: its encoder or projection, then the shared layers, then the shared classifier."""
    encode, share = network(encoder, relu_last=True), network(backbone, relu_last=True)

    @F.pandas_udf("double")
    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series((share(encode(_matrix(batch))) @ head[0].T + head[1])[:, 0])

    return forward(features)


def modality(name: str, options: dict):
    """The parts of a modality; an unknown one is an error."""
    if name not in options:
        raise ValueError(f"unknown modality: {name}")
    return options[name]


def tokens_of(features: Column, width: int) -> Column:
    """Cut a flat array into consecutive tokens of ``width``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(features) - 1) / width).cast("int")), lambda t: F.slice(features, t * width + 1, width))


def _beside(values: Column, statistic: Column, combine) -> Column:
    """Combine each element with one statistic of the row, which is evaluated once and not per element."""
    return F.zip_with(values, F.array_repeat(statistic, F.size(values)), combine)


def layer_norm(values: Column, epsilon: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + epsilon)."""
    add = lambda total, x: total + x
    centred = _beside(values, F.aggregate(values, F.lit(0.0), add) / F.size(values), lambda x, mean: x - mean)
    variance = F.aggregate(centred, F.lit(0.0), lambda total, x: total + x * x) / F.size(values)
    return _beside(centred, F.sqrt(variance + F.lit(epsilon)), lambda x, spread: x / spread)


def softmax(logits: Column) -> Column:
    largest = F.array_max(logits)
    powers = _beside(logits, largest, lambda z, m: F.exp(z - m))
    return _beside(powers, F.aggregate(powers, F.lit(0.0), lambda total, x: total + x), lambda x, total: x / total)


def mean_pool(tokens: Column, width: int, skip_first: bool = False) -> Column:
    """The mean over tokens; ``skip_first`` leaves the class token out."""
    used = F.slice(tokens, 2, F.size(tokens) - 1) if skip_first else tokens
    total = F.aggregate(used, F.array_repeat(F.lit(0.0), width), lambda acc, token: F.zip_with(acc, token, lambda a, b: a + b))
    return _beside(total, F.size(used).cast("double"), lambda x, n: x / n)


def gelu(x: np.ndarray) -> np.ndarray:
    """x · Φ(x), with the error function by its five-term approximation (error below 2e-7)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 0.5 * x * (1 + np.sign(x) * erf)


def _normed(x: np.ndarray, epsilon: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred * centred).mean(-1, keepdims=True) + epsilon)


def self_attention(x: np.ndarray, query: Layer, key: Layer, value: Layer, out: Layer, heads: int) -> np.ndarray:
    """Multi-head self-attention of [rows, tokens, width]."""
    n, tokens, width = x.shape
    q, k, v = ((x @ w.T + b).reshape(n, tokens, heads, width // heads).transpose(0, 2, 1, 3) for w, b in (query, key, value))
    weights = q @ k.transpose(0, 1, 3, 2) / np.sqrt(width // heads)
    weights = np.exp(weights - weights.max(-1, keepdims=True))
    mixed = (weights / weights.sum(-1, keepdims=True)) @ v
    return mixed.transpose(0, 2, 1, 3).reshape(n, tokens, width) @ out[0].T + out[1]


def encoder_layer(x: np.ndarray, parts: dict[str, Layer], heads: int) -> np.ndarray:
    """Attention and a GELU feed-forward, each with a residual and a norm after it; dropout is the identity when scoring."""
    x = _normed(x + self_attention(x, parts["query"], parts["key"], parts["value"], parts["out"], heads))
    hidden = gelu(x @ parts["up"][0].T + parts["up"][1])
    return _normed(x + hidden @ parts["down"][0].T + parts["down"][1])


def hybrid_parts(features: int, model: int, forward: int, layers: int, tokens: int) -> dict:
    """Formula weights of the hybrid: projection, class token, positions, encoder layers, head."""
    shapes = {"query": (model, model), "key": (model, model), "value": (model, model), "out": (model, model), "up": (forward, model), "down": (model, forward)}
    return {
        "project": formula_weights(model, features, 1),
        "first": np.sin(np.arange(model) + 1.0) / 10,
        "positions": np.sin(np.arange((tokens + 1) * model).reshape(tokens + 1, model) + 1.0) / 10,
        "layers": [{name: formula_weights(*shape, 100 * layer + 10 * i) for i, (name, shape) in enumerate(shapes.items())} for layer in range(layers)],
        "head": [formula_weights(model, model, 7), formula_weights(1, model, 8)],
    }


def hybrid_logits(x: np.ndarray, parts: dict, heads: int) -> np.ndarray:
    """[rows] logits of [rows, tokens, features]: projected, class token and positions added, encoded, normed, the picture tokens' mean (without the class token), two layers."""
    tokens = x @ parts["project"][0].T + parts["project"][1]
    first = np.broadcast_to(parts["first"], (len(x), 1, len(parts["first"])))
    tokens = np.concatenate([first, tokens], axis=1) + parts["positions"]
    for layer in parts["layers"]:
        tokens = encoder_layer(tokens, layer, heads)
    return network(parts["head"], relu_last=False)(_normed(tokens)[:, 1:].mean(1))[:, 0]


def attention(tokens: Column, query: np.ndarray, key: np.ndarray, value: np.ndarray, heads: int) -> Column:
    """Multi-head self-attention of array<array<double>> tokens with given projection matrices."""

    @F.pandas_udf("array<array<double>>")
    def run(batch: pd.Series) -> pd.Series:
        out = []
        for rows in batch:
            x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
            parts = []
            for q, k, v in zip(*(np.split(x @ m.T, heads, axis=1) for m in (query, key, value))):
                weights = q @ k.T / np.sqrt(q.shape[1])
                weights = np.exp(weights - weights.max(1, keepdims=True))
                parts.append(weights / weights.sum(1, keepdims=True) @ v)
            out.append(np.concatenate(parts, axis=1).tolist())
        return pd.Series(out)

    return run(tokens)


def with_scores(df: DataFrame, features: str, weights: Sequence[float], bias: float = 0.0) -> DataFrame:
    """Add z and p = sigmoid(z) of a linear head."""
    return df.withColumn("z", linear(F.col(features), weights, bias)).withColumn("p", sigmoid(F.col("z")))
