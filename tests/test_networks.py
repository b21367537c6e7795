import numpy as np
import pytest

from cohortlab.operators import networks


def loss(network, weights, image, clinical, y_image, y_clinical, w):
    bce = lambda z, y: np.mean(w * y * np.logaddexp(0, -z[:, 0]) + (1 - y) * np.logaddexp(0, z[:, 0]))
    z = network.logits(weights, image, clinical)
    return sum(bce(v, y_clinical if head == "clinical" else y_image) for head, v in z.items())


@pytest.mark.parametrize("network", [networks.SharedBackbone(5, 4, (6, 5), 5, (4, 3)), networks.LateFusion(5, 4, (6, 3), 4)])
def test_gradients_against_differences(network):
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in networks.initial(network.sizes, 1).items()}
    data = (rng.normal(size=(9, 5)), rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float), rng.integers(0, 2, 9).astype(float))
    grads = network.gradients(weights, *data, 2.5)
    for name in weights:
        for at in list(np.ndindex(weights[name].shape))[:4]:
            moved = {k: v.copy() for k, v in weights.items()}
            moved[name][at] += 1e-5
            up = loss(network, moved, *data, 2.5)
            moved[name][at] -= 2e-5
            assert grads[name][at] == pytest.approx((up - loss(network, moved, *data, 2.5)) / 2e-5, abs=2e-4)


@pytest.mark.parametrize("shard_rows,epochs,step", [(200_000, 8, 0.01), (90, 14, 0.03)])
def test_training_separates_and_repeats(spark, monkeypatch, shard_rows, epochs, step):
    monkeypatch.setattr(networks, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        y, c = int(i % 5 == 0), int(i % 3 == 0)
        rows.append((i, (rng.normal(size=6) + 1.5 * y).tolist(), (rng.normal(size=4) + 1.5 * c).tolist(), y, c))
    rows += [(900, None, [0.0] * 4, 1, 1), (901, [0.0] * 6, [float("nan")] * 4, 1, 1), (902, [0.0] * 6, [0.0] * 4, None, 1)]
    df = spark.createDataFrame(rows, "id long, image array<double>, clinical array<double>, y int, c int")
    for network, heads in ((networks.SharedBackbone(6, 4, (16, 12), 12, (8,)), {"image", "clinical"}), (networks.LateFusion(6, 4, (16, 8), 12), {"image", "clinical", "fusion"})):
        weights = networks.train(df, network, "id", "image", "clinical", "y", "c", 2.0, epochs=epochs, step=step)
        again = networks.train(df.repartition(5), network, "id", "image", "clinical", "y", "c", 2.0, epochs=epochs, step=step)
        assert all(np.allclose(weights[k], again[k], atol=1e-5) for k in weights)
        out = networks.scored(df.where("id < 400"), network, weights, "image", "clinical", ["id", "y", "c"]).toPandas()
        assert {c[2:] for c in out.columns if c.startswith("p_")} == heads
        for head in heads:
            truth = out["c" if head == "clinical" else "y"]
            assert out[f"p_{head}"][truth == 1].mean() > out[f"p_{head}"][truth == 0].mean() + 0.25
    one = networks.scored(df.where("id < 400"), networks.SharedBackbone(6, 4, (16, 12), 12, (8,)), networks.initial(networks.SharedBackbone(6, 4, (16, 12), 12, (8,)).sizes), "image", None, ["id"])
    assert one.columns == ["id", "p_image"] and one.count() == 400


def test_no_rows_leave_the_initial_weights(spark):
    df = spark.createDataFrame([], "id long, image array<double>, clinical array<double>, y int, c int")
    network = networks.LateFusion(6, 4, (5,), 3)
    weights = networks.train(df, network, "id", "image", "clinical", "y", "c", 1.0)
    assert all((weights[k] == v).all() for k, v in networks.initial(network.sizes).items())


def test_frozen_layers_keep_their_weights(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist(), rng.normal(size=3).tolist(), i % 2, i % 2) for i in range(70)], "id long, image array<double>, clinical array<double>, y int, c int")
    network = networks.SharedBackbone(3, 3, (4,), 4, (3,))
    before = networks.initial(network.sizes)
    after = networks.train(df, network, "id", "image", "clinical", "y", "c", 1.0, epochs=1, step=0.01, frozen=("project", "encode0"))
    assert {k for k in before if not (before[k] == after[k]).all()} == {"share0.w", "share0.b", "classify.w", "classify.b"}
    with pytest.raises(ValueError):
        networks.trainable(before, ("layer4",))


def test_adam_steps_are_in_place_and_in_blocks(monkeypatch):
    """Steps over a whole layer at once made a dozen arrays of its size a batch."""
    monkeypatch.setattr(networks, "ADAM_BLOCK", 7)
    rng = np.random.default_rng(6)
    w, m, v = (rng.random(40).astype(np.float32) for _ in range(3))
    held, want = (w, m, v), [x.copy() for x in (w, m, v)]
    for t in (1, 2, 3):
        grads = rng.normal(size=40).astype(np.float32)
        g = grads + networks.DECAY * want[0]
        want[1] += 0.1 * (g - want[1])
        want[2] += 0.001 * (g * g - want[2])
        want[0] -= 0.01 * (want[1] / (1 - 0.9**t)) / (np.sqrt(want[2] / (1 - 0.999**t)) + 1e-8)
        networks._adam(w, grads, m, v, 0.01, t)
    assert all((a == b).all() for a, b in zip(held, want))
