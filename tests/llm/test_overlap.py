import numpy as np

from cohortlab.llm import overlap

TRAIN = "sample_id long, images array<float>, origin string"
EVALUATION = "sample_id long, images array<float>, eval_split string, origin string"


def picture(rng):
    x = rng.normal(size=(3, 16, 16))
    for _ in range(2):
        x = (x + np.roll(x, 1, 1) + np.roll(x, 1, 2) + np.roll(x, -1, 1)) / 4
    return (x / x.std()).astype(np.float32)


def rows(spark, schema, *parts):
    return spark.createDataFrame([(i, None if x is None else [float(v) for v in np.asarray(x).ravel()], *rest) for i, x, *rest in parts], schema)


def noisy(rng, x, alike):
    noise = rng.normal(size=x.shape)
    centred = x - x.mean()
    noise *= np.linalg.norm(centred) / np.linalg.norm(noise) * np.sqrt(1 / alike**2 - 1)
    return x + noise


def test_found_as_brute_force(spark):
    rng = np.random.default_rng(0)
    base = [picture(rng) for _ in range(120)]
    turns = [lambda x: x, lambda x: x[:, :, ::-1], lambda x: x[:, ::-1], lambda x: x[:, ::-1, ::-1]]
    train = [(i, x, "a") for i, x in enumerate(base)] + [(200, base[3], "b"), (201, None, "b"), (202, np.ones((3, 16, 16)), "b"), (203, np.ones(5), "b")]
    evaluation = [(1000 + i, turns[i % 4](noisy(rng, base[i] * 1.3 + 0.2, 0.995)) if i else base[0], "holdout", None) for i in range(60)]
    evaluation += [(2000 + i, noisy(rng, base[60 + i], 0.9), "validation", "x") for i in range(30)] + [(3000, None, "validation", None), (3001, np.zeros((3, 16, 16)), "validation", None), (3002, base[3], "validation", None)]
    t, e = rows(spark, TRAIN, *train), rows(spark, EVALUATION, *evaluation)
    pairs = overlap.cross_split(t, e)
    got = {(r.train_sample_id, r.validation_sample_id) for r in pairs.collect()}
    unit = lambda x: (x - x.mean()) / np.linalg.norm(x - x.mean())
    usable = lambda parts: [(i, unit(np.asarray(x, dtype=np.float32).astype(float))) for i, x, *_ in parts if x is not None and np.size(x) == 768 and np.ptp(x) > 0]
    want = {(i, j) for i, a in usable(train) for j, b in usable(evaluation) if max((a * turn(b)).sum() for turn in turns) >= 0.97}
    assert want >= {(i, 1000 + i) for i in range(60)} | {(200, 3002), (3, 3002), (200, 1003)}
    assert got == want
    report = {(r.eval_split, r.origin): r for r in overlap.report(pairs, e).collect()}
    assert report["holdout", None].samples == 60 and report["holdout", None].exact == 1 and report["validation", "x"].overlapping == 0


def test_patches_and_grey_noise_are_found(spark):
    rng = np.random.default_rng(11)
    base = [picture(rng) for _ in range(300)]

    def patched(x):
        noise = np.zeros_like(x)
        noise[:, 5:10, 6:11] = rng.normal(size=(3, 5, 5))
        return noise

    def added(x, noise, alike):
        for _ in range(40):  # noise is not quite orthogonal to the picture: scaled until the correlation fits
            a, b = (y - y.mean() for y in (x, x + noise))
            now = (a * b).sum() / np.linalg.norm(a) / np.linalg.norm(b)
            noise = noise * (np.sqrt(1 / alike**2 - 1) / np.sqrt(1 / min(now, 1 - 1e-9) ** 2 - 1))
        return x + noise

    kinds = (patched, lambda x: np.repeat(rng.normal(size=(1, 16, 16)), 3, 0))
    evaluation = [(1000 * (k + 1) + i, added(x, kind(x), 0.9705)[:, :, :: 1 - 2 * (i % 2)], "holdout", "o") for k, kind in enumerate(kinds) for i, x in enumerate(base)]
    t, e = rows(spark, TRAIN, *[(i, x, "a") for i, x in enumerate(base)]), rows(spark, EVALUATION, *evaluation)
    got = {(r.train_sample_id, r.validation_sample_id): r.overlap for r in overlap.cross_split(t, e).collect()}
    unit = lambda x: (x - x.mean()) / np.linalg.norm(x - x.mean())
    stored = [unit(x.astype(np.float32).astype(float)) for x in base]
    want = {(i, v) for v, x, *_ in evaluation for i in (v % 1000,) if max((stored[i] * unit(x.astype(np.float32).astype(float)[:, :, ::s])).sum() for s in (1, -1)) >= 0.97}
    assert len(want) > 500 and want <= set(got)
    assert 0 <= min(got.values()) < overlap.LEAST_OVERLAP < max(got.values()) < 1


def test_same_pictures_overlap_fully(spark):
    x = picture(np.random.default_rng(5))
    t, e = rows(spark, TRAIN, (1, x, "a"), (1, x, "a"), (2, x, "a")), rows(spark, EVALUATION, (9, x[:, :, ::-1], "v", "o"), (9, x[:, :, ::-1], "v", "o"))
    got = sorted(map(tuple, overlap.cross_split(t, e).collect()))
    assert [g[:2] for g in got] == [(1, 9), (2, 9)] and all(g[2] == 1 and abs(g[3] - 1) < 1e-6 for g in got)


def test_chunks_cover_the_record_and_fall_into_step_again():
    rng = np.random.default_rng(6)
    waves, usable = overlap.transform(np.stack([picture(rng).ravel() for _ in range(200)]))
    assert usable.all()
    rows, digests, lengths = overlap.chunks(waves)
    assert (np.bincount(rows, weights=lengths) == overlap.SIGNS * overlap.ORDERS).all()
    assert lengths.min() >= overlap.SHORTEST and lengths.max() < overlap.LONGEST + overlap.SHORTEST and len(set(lengths)) > 8
    changed = waves.copy()
    changed[:, 0, 10] *= -1
    _, after, _ = overlap.chunks(changed)
    one, two = (set(zip(rows_, d)) for rows_, d in ((rows, digests), (overlap.chunks(changed)[0], after)))
    # the grey mean is one of four components, and most of its chunks lie beyond the changed symbol
    assert len(one & two) > 0.75 * len(one)
    # cuts fall into step: some orders that were changed early end in the same chunk
    ends = [len({c for c in one if c[0] == r} & {c for c in two if c[0] == r}) for r in range(200)]
    assert max(ends) > min(ends)


def test_larger_pictures_and_other_channels(spark):
    rng = np.random.default_rng(8)
    for channels, side in ((3, 224), (1, 20)):
        base = [np.kron(rng.normal(size=(channels, side // 4, side // 4)), np.ones((4, 4))).astype(np.float32) for _ in range(4)]
        t = rows(spark, TRAIN, *[(i, x, "a") for i, x in enumerate(base)], (9, np.ones(768), "a"))
        e = rows(spark, EVALUATION, (100, base[2][:, ::-1] * 2 + 1, "v", "o"), (101, base[0] + 0.05 * rng.normal(size=base[0].shape), "v", "o"), (102, np.ones(768), "v", "o"))
        got = {(r.train_sample_id, r.validation_sample_id): r.overlap for r in overlap.cross_split(t, e, channels=channels, side=side).collect()}
        assert set(got) == {(2, 100), (0, 101)} and got[2, 100] > 0.9


def test_popular_digests_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = picture(rng)
    train = [(i, noisy(rng, x, 0.99), "a") for i in range(60)]
    t, e = rows(spark, TRAIN, *train), rows(spark, EVALUATION, (100, x, "v", "o"))
    whole = {tuple(r)[:3] for r in overlap.cross_split(t, e).collect()}
    monkeypatch.setattr(overlap, "BOX_ROWS", 10)
    monkeypatch.setattr(overlap, "LEAF_SAMPLE", 2)
    monkeypatch.setattr(overlap, "POPULAR_PART", 1)
    monkeypatch.setattr(overlap, "sharing", lambda left, right: sharing(left, right, popular=3))
    assert {tuple(r)[:3] for r in overlap.cross_split(t, e).collect()} == whole and len(whole) == 60


sharing = overlap.sharing


def test_empty(spark):
    t, e = rows(spark, TRAIN, (1, picture(np.random.default_rng(7)), "a")), rows(spark, EVALUATION, (2, None, "v", None))
    assert overlap.cross_split(t, e).count() == 0
    assert overlap.cross_split(t.limit(0), e.limit(0)).count() == 0
    assert overlap.report(overlap.cross_split(t, e), e).first().overlapping == 0
