import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import losses, scoring


def test_linear_sigmoid(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],)], "x array<float>")
    rows = scoring.with_scores(df, "x", [0.5, -1.0], 0.25).collect()
    assert [r.z for r in rows] == [-1.25, 0.25] and rows[1].p == pytest.approx(1 / (1 + np.exp(-0.25)))


def test_networks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    clin, fus = [scoring.formula_weights(5, 6), scoring.formula_weights(4, 5)], scoring.formula_weights(7, 10)
    heads = [scoring.formula_weights(1, n, n) for n in (6, 4, 7)]
    got = df.select("id", scoring.late_fusion(F.col("x"), F.col("x"), clin, heads[0], heads[1], fus, heads[2]).alias("l")).orderBy("id").collect()
    c = np.maximum(np.maximum(x @ clin[0][0].T + clin[0][1], 0) @ clin[1][0].T + clin[1][1], 0)
    j = np.maximum(np.concatenate([x, c], 1) @ fus[0].T + fus[1], 0)
    want = [(a @ w.T + b)[:, 0] for a, (w, b) in zip((x, c, j), heads)]
    for i, name in enumerate(("image_logit", "clinical_logit", "fusion_logit")):
        assert np.allclose([r.l[name] for r in got], want[i])
    logits = df.select("id", scoring.shared_backbone(F.col("x"), clin, [scoring.formula_weights(3, 4)], scoring.formula_weights(1, 3)).alias("z")).orderBy("id").collect()
    w, b = scoring.formula_weights(3, 4)
    assert np.allclose([r.z for r in logits], (np.maximum(c @ w.T + b, 0) @ scoring.formula_weights(1, 3)[0].T + scoring.formula_weights(1, 3)[1])[:, 0])
    assert scoring.parameter_count(clin) == 6 * 5 + 5 + 5 * 4 + 4
    with pytest.raises(ValueError):
        scoring.modality("sound", {"image": 1})


def test_norm_pool_softmax_attention(spark):
    x = np.random.default_rng(1).normal(size=12)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    t = x.reshape(3, 4)
    row = df.select(
        scoring.layer_norm(F.col("x")).alias("n"), scoring.mean_pool(scoring.tokens_of(F.col("x"), 4), 4).alias("m"), scoring.mean_pool(scoring.tokens_of(F.col("x"), 4), 4, True).alias("s"), scoring.softmax(F.col("x")).alias("p"),
        scoring.attention(scoring.tokens_of(F.col("x"), 4), np.eye(4), np.eye(4), np.eye(4), 2).alias("a"),
    ).first()
    assert np.allclose(row.n, (x - x.mean()) / np.sqrt(x.var() + 1e-5)) and np.allclose(row.m, t.mean(0)) and np.allclose(row.s, t[1:].mean(0))
    assert np.allclose(row.p, np.exp(x) / np.exp(x).sum())
    half = []
    for part in np.split(t, 2, axis=1):
        w = np.exp(part @ part.T / np.sqrt(2))
        half.append(w / w.sum(1, keepdims=True) @ part)
    assert np.allclose(row.a, np.concatenate(half, 1))


def test_losses(spark):
    z, y = np.array([-800.0, -2, 0, 3, 800]), np.array([0, 1, 1, 0, 1])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(z, y)], "z double, y int")
    rows = df.select(losses.bce(F.col("z"), F.col("y"), 2.0).alias("b"), losses.focal(F.col("z"), F.col("y")).alias("f")).collect()
    plain = np.where(y == 1, np.logaddexp(0, -z), np.logaddexp(0, z))
    assert np.allclose([r.b for r in rows], np.where(y == 1, 2, 1) * plain)
    assert np.allclose([r.f for r in rows], 0.75 * (1 - np.exp(-plain)) ** 2 * plain)


def test_epoch_means(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (1, 10.0)], "batch int, loss double")
    assert losses.epoch_weighted(df, "batch", "loss").first().epoch_loss == 4.0
    assert losses.epoch_batch_mean(df, "batch", "loss").first().epoch_loss == 6.0


def test_gelu_and_encoder_layer():
    from math import erf

    x = np.linspace(-6, 6, 401)
    assert np.abs(scoring.gelu(x) - [0.5 * v * (1 + erf(v / 2**0.5)) for v in x]).max() < 2e-6
    rng = np.random.default_rng(0)
    parts = scoring.hybrid_parts(6, 8, 10, 2, 3)
    pictures = rng.normal(size=(4, 3, 6))
    got = scoring.hybrid_logits(pictures, parts, 2)

    def norm(v):
        return (v - v.mean()) / np.sqrt(v.var() + 1e-5)

    for picture, logit in zip(pictures, got):
        tokens = [parts["first"]] + [parts["project"][0] @ t + parts["project"][1] for t in picture]
        tokens = [t + p for t, p in zip(tokens, parts["positions"])]
        for layer in parts["layers"]:
            q, k, v = ([layer[n][0] @ t + layer[n][1] for t in tokens] for n in ("query", "key", "value"))
            mixed = []
            for i in range(4):
                heads = []
                for h in (slice(0, 4), slice(4, 8)):
                    w = np.exp([q[i][h] @ k[j][h] / 2 for j in range(4)])
                    heads.append(sum(a * v[j][h] for j, a in enumerate(w / w.sum())))
                mixed.append(layer["out"][0] @ np.concatenate(heads) + layer["out"][1])
            tokens = [norm(t + m) for t, m in zip(tokens, mixed)]
            tokens = [norm(t + layer["down"][0] @ scoring.gelu(layer["up"][0] @ t + layer["up"][1]) + layer["down"][1]) for t in tokens]
        pooled = np.mean([norm(t) for t in tokens[1:]], axis=0)
        hidden = np.maximum(parts["head"][0][0] @ pooled + parts["head"][0][1], 0)
        assert logit == pytest.approx((parts["head"][1][0] @ hidden + parts["head"][1][1])[0], abs=1e-9)
