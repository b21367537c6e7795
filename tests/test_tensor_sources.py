import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import models, tensor
from cohortlab.sources import npz, readers, writers
from cohortlab.streaming.scoring import cap_stream, score_stream


def png(path, pixels):
    """A minimal PNG writer for the tests."""
    height, width, channels = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    kind = {1: 0, 3: 2, 4: 6}[channels]
    with open(path, "wb") as out:
        out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_layout_and_flips(spark):
    x = np.arange(3 * 4 * 5, dtype=float).reshape(3, 4, 5)
    df = spark.createDataFrame([(x.ravel().tolist(),)], "x array<double>")
    row = df.select(
        tensor.to_channels_last(F.col("x"), 3, 20).alias("last"), tensor.to_channels_first(tensor.to_channels_last(F.col("x"), 3, 20), 3, 20).alias("back"), tensor.flip_lr(F.col("x"), 5).alias("lr"), tensor.flip_tb(F.col("x"), 5, 4).alias("tb"),
        tensor.denormalize(tensor.normalize(F.col("x"), 20, 100.0), 20).alias("same"),
    ).first()
    assert np.array_equal(row.last, x.transpose(1, 2, 0).ravel()) and np.array_equal(row.back, x.ravel())
    assert np.array_equal(row.lr, x[:, :, ::-1].ravel()) and np.array_equal(row.tb, x[:, ::-1].ravel())
    assert np.allclose(row.same, x.ravel() / 100)


def test_letterbox_truncates(spark):
    df = spark.range(1, 3000).select(F.col("id").cast("double").alias("w"))
    rows = df.select("w", *tensor.letterbox(F.col("w"), F.lit(1.0) * F.col("w"))).collect()
    for r in rows:
        assert r.new_width == int(r.w * (224 / r.w)) and r.left == (224 - r.new_width) // 2
    assert {r.w: r.new_width for r in rows}[55.0] == int(55 * (224 / 55))


def test_pixels():
    flat = np.full((10, 20, 3), 77, dtype=np.uint8)
    out = tensor.letterbox_stack(flat[None], 40)[0]
    assert out.shape == (40, 40, 3) and (out[10:30] == 77).all() and (out[:10] == 0).all() and (out[30:] == 0).all()
    spot = np.zeros((9, 9, 3), dtype=np.uint8)
    spot[4, 4] = 200
    turned = tensor.rotate_stack(np.stack([spot, spot]), [0, 5])
    assert (turned[0] == spot).all() and turned[1, 4, 4, 0] == 200
    assert tensor.augment_stack(spot[None], np.full((1, 5), 0.9)).shape == (1, *spot.shape)


def test_resampling_against_plain_loops():
    rng = np.random.default_rng(2)
    picture = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    kernel = lambda x: np.sinc(x) * np.sinc(x / 3) if abs(x) < 3 else 0.0

    def line(values, n):
        stretch, out = max(len(values) / n, 1.0), []
        for i in range(n):
            weights = [kernel((k + 0.5 - (i + 0.5) * len(values) / n) / stretch) for k in range(len(values))]
            out.append(sum(w * v for w, v in zip(weights, values)) / sum(weights))
        return out

    for target in (9, 3):
        ratio = min(target / 4, target / 5)
        w, h = int(4 * ratio), int(5 * ratio)
        want = np.zeros((target, target, 3))
        for c in range(3):
            tall = np.array([line(picture[:, x, c].astype(float), h) for x in range(4)]).T
            want[(target - h) // 2 : (target - h) // 2 + h, (target - w) // 2 : (target - w) // 2 + w, c] = [line(row, w) for row in tall]
        assert np.abs(tensor.letterbox_stack(picture[None], target)[0] - np.clip(np.rint(want), 0, 255)).max() <= 1


def test_draws_depend_on_the_whole_key():
    draws = tensor.draws_of([123, 1000123, 2000123, 123], [24, 24, 24, 4])
    assert len({tuple(d) for d in draws}) == 4 and (tensor.draws_of([123], [24])[0] == draws[0]).all() and 0 <= draws.min() <= draws.max() < 1


def test_nulls_and_layout_detection(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],), (None,), ([],)], "x array<float>")
    rows = df.select(tensor.as_channels_first(F.col("x"), (1, 2, 3)).alias("turned"), tensor.as_channels_first(F.col("x"), (3, 1, 2)).alias("same"), tensor.normalize(F.col("x"), 2, 1.0, (0, 0, 0), (1, 1, 1)).alias("n"), tensor.position_sum(F.col("x")).alias("s")).collect()
    assert rows[0].turned == [1, 4, 2, 5, 3, 6] and rows[0].same == [1, 2, 3, 4, 5, 6] and rows[0].s == 91
    assert rows[1].n is None and rows[1].turned is None and rows[1].s is None and rows[2].n == [] and rows[2].s == 0


def test_picture_step(spark):
    data = np.random.default_rng(0).integers(0, 255, 4 * 6 * 3).tolist()
    df = spark.createDataFrame([(1, data, 6, 4, 0), (1, data, 6, 4, 1), (2, data[:-1], 6, 4, 0), (3, None, 6, 4, 0)], "id long, d array<int>, w int, h int, copy int")
    rows = {r.copy: r.tensor for r in tensor.picture_step(df, "id", "d", "w", "h", 8, augment=True, copy="copy").collect()}
    assert set(rows) == {0, 1} and rows[0] != rows[1] and len(rows[0]) == 8 * 8 * 3 and isinstance(rows[0], (bytes, bytearray))
    plain = tensor.picture_step(df, "id", "d", "w", "h", 8).first().tensor
    assert plain == rows[0]


def test_sums_equal_those_of_the_tensors(spark):
    rng = np.random.default_rng(5)
    shapes = [(6, 4), (16, 16), (3, 9)]
    rows = [(i, rng.integers(0, 256, w * h * 3).tolist(), w, h, i % 3) for i, (w, h) in enumerate(shapes * 20)] + [(90, None, 6, 4, 0), (91, [1, 2], 6, 4, 1), (92, [7] * 72, None, 4, 1)]
    df = spark.createDataFrame(rows, "id long, d array<int>, w int, h int, copy int")
    tensors = {r.id: np.frombuffer(r.tensor, dtype=np.uint8).astype(np.int64) for r in tensor.picture_step(df, "id", "d", "w", "h", augment=True, copy="copy").collect()}
    sums = {r.id: (r.n_values, r.position_sum) for r in tensor.picture_step(df, "id", "d", "w", "h", augment=True, copy="copy", sums=True).collect()}
    assert set(tensors) == set(range(60))
    assert sums == {i: (len(t), float((t * np.arange(1, len(t) + 1)).sum())) for i, t in tensors.items()}


def test_picture_queries_keep_tensors_in_the_worker(spark, monkeypatch):
    """10,000 tensors of 150 KB in one Arrow batch are 1.5 GB."""
    from cohortlab.plans import imaging

    few = spark.createDataFrame([(1, 1, [0.1] * 768), (2, 0, [-3.0 + k / 100 for k in range(768)])], "sample_id long, labels long, images array<float>").withColumn("aug_k", F.lit(0))
    monkeypatch.setattr(imaging, "_images", lambda spark, folder: few)
    for query, n in ((imaging.image_letterbox, 2), (imaging.image_augment, 26)):
        df = query(spark, "")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "binary" not in df._jdf.queryExecution().analyzed().toString() and "ArrowEvalPython" not in plan and df.count() == n
    pixels = tensor.to_bytes_scale(tensor.to_channels_last(tensor.denormalize(F.col("images"), 256), 3, 256))
    for r in few.select("images", pixels.alias("p")).collect():
        assert tensor.pixels_of(np.array([r.images]), 256).ravel().tolist() == r.p


def test_large_pictures_come_in_small_parts(spark, monkeypatch):
    seen, whole = [], tensor.letterbox_stack
    monkeypatch.setattr(tensor, "letterbox_stack", lambda p, target: seen.append(p.size) or whole(p, target))
    df = spark.createDataFrame([(i, [0] * (300 * 300 * 3), 300, 300) for i in range(20)], "id long, d array<int>, w int, h int")
    held = df.toArrow().to_batches()
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: list(run(iter(held))))
    parts = tensor.picture_step(df, "id", "d", "w", "h")
    assert sum(p.num_rows for p in parts) == 20 and max(seen) <= tensor.PART_VALUES


def test_readers(spark, tmp_path):
    root = tmp_path / "data"
    for folder in ("OTU_2d/images", "OTU_3d/annotations"):
        os.makedirs(root / folder)
    red = np.zeros((3, 2, 3), dtype=np.uint8)
    red[..., 0], red[..., 1], red[..., 2] = 10, 20, 30
    png(root / "OTU_2d/images/1.png", red)
    png(root / "OTU_2d/images/2.PNG", red[..., :1])
    (root / "OTU_2d/images/bad.png").write_bytes(b"junk")
    (root / "OTU_2d/top.txt").write_text(" 2.JPG\t0\n\nx.y.JPG 7\nz.jpg q\n")
    (root / "OTU_3d/annotations/a.txt").write_text("")
    (root / "outside.txt").write_text("")
    images = {os.path.basename(r.path): r for r in readers.read_images(spark, str(root / "OTU_2d/images")).collect()}
    assert set(images) == {"1.png", "2.PNG"} and images["1.png"].pixels[:3] == [10, 20, 30] and images["2.PNG"].pixels[:3] == [10, 10, 10] and images["1.png"].width == 2
    files = readers.list_files(spark, str(root))
    assert {r.suffix: r.n for r in readers.suffix_counts(files).collect()} == {".png": 3, ".txt": 3}
    counts = {(r.major, r.folder): r.n for r in readers.folder_counts(files, str(root)).collect()}
    assert counts == {("OTU_2d", "images"): 3, ("OTU_2d", "top.txt"): 1, ("OTU_2d", None): 4, ("OTU_3d", "annotations"): 1, ("OTU_3d", None): 1}
    labels = [(r.filename, r.original_label, r.binary_label, r.stem) for r in readers.read_labels(spark, str(root / "OTU_2d/top.txt")).collect()]
    assert labels == [("2.JPG", 0, 0, "2"), ("x.y.JPG", 7, 1, "x.y"), ("z.jpg", None, None, "z")]


def test_csv_npz_and_writer(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b,c\n1,x,2.5\n2,y,\n")
    assert dict(readers.read_csv(spark, str(tmp_path / "c.csv")).dtypes) == {"a": "int", "b": "string", "c": "double"}
    x = np.random.default_rng(0).normal(size=(300, 2, 3)).astype(np.float32)
    np.savez_compressed(tmp_path / "s.npz", images=x, labels=np.arange(300))
    rows = readers.read_npz(spark, str(tmp_path / "s.npz")).orderBy("row").collect()
    assert len(rows) == 300 and np.allclose(rows[299]["values"], x[299].ravel()) and rows[299].label == 299
    writers.write_dataset(spark.createDataFrame([(1, "train"), (2, "test")], "v int, set string"), str(tmp_path / "out"))
    assert sorted(p for p in os.listdir(tmp_path / "out") if "=" in p) == ["set=test", "set=train"]


def test_npz_writer_splits_and_reads_back(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(25, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(90, None, 1), (91, [1.0] * 6, None)], "id long, v array<float>, y long").coalesce(1)
    assert writers.write_npz(df, str(tmp_path / "npz"), "v", "y", rows=10) == 25
    assert sorted(os.listdir(tmp_path / "npz")) == [f"part-00000-0000{i}.npz" for i in range(3)]
    rows = readers.read_npz(spark, str(tmp_path / "npz")).collect()
    assert sorted(tuple(r["values"]) for r in rows) == sorted(map(tuple, x.tolist())) and sum(r.label for r in rows) == 12
    assert writers.write_npz(df.limit(0), str(tmp_path / "none"), "v", "y") == 0
    npz.register(spark)
    again = spark.read.format("npz").load(str(tmp_path / "npz")).collect()
    assert sorted((tuple(r["values"]), r.label) for r in again) == sorted((tuple(r["values"]), r.label) for r in rows)
    assert spark.read.format("npz").load(str(tmp_path / "npz/part-00000-00002.npz")).count() == 5


def test_missing_folders_are_named(spark, tmp_path):
    for read in (readers.list_files, readers.read_images):
        with pytest.raises(FileNotFoundError, match="nowhere"):
            read(spark, str(tmp_path / "nowhere"))


def test_stream_equals_batch(spark, tmp_path):
    table = spark.createDataFrame([(i, [float(i), 1.0], float(i)) for i in range(20)], "id long, x array<double>, v double")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = cap_stream(score_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "x", [0.1, -0.5]), {"v": (2.0, 10.0)})
    query = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = cap_stream(score_stream(table, "x", [0.1, -0.5]), {"v": (2.0, 10.0)})
    assert sorted(map(str, spark.table("scored").collect())) == sorted(map(str, batch.collect()))


def test_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=3) + (i % 4 == 0)).tolist(), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    fitted = models.fit_scores(df, df, models.logistic_head(), "id", "x", "y")
    assert fitted.count() == 200 and fitted.where("y = 1").agg(F.avg("p")).first()[0] > fitted.where("y = 0").agg(F.avg("p")).first()[0] + 0.1
    forest = models.random_forest(trees=5, depth=4)
    model = forest.fit(models.prepared(df, "x", "y", 4.0).withColumn("label", F.col("y").cast("double")))
    models.save(model, str(tmp_path / "forest"))
    assert models.load(str(tmp_path / "forest")).getNumTrees == 5
    # without weights: the rare class is replicated first
    mlp = models.mlp_head(3, (4,), 20).fit(models.prepared(df, "x", "y", 1.0).withColumn("label", F.col("y").cast("double")))
    assert mlp.transform(models.prepared(df, "x", "y", 1.0)).count() == 200


def test_picture_queries_make_every_copy_at_full_size(spark, monkeypatch):
    from cohortlab.plans import imaging

    few = spark.createDataFrame([(i, label, [(i + k % 7) / 10 for k in range(768)]) for i, label in ((1, 0), (2, 1), (3, None))], "sample_id long, labels long, images array<float>").withColumn("aug_k", F.lit(0))
    monkeypatch.setattr(imaging, "_images", lambda spark, folder: few)
    boxed = imaging.image_letterbox(spark, "").collect()
    assert sorted((r.sample_id, r.n_values) for r in boxed) == [(i, 224 * 224 * 3) for i in (1, 2, 3)]
    copies = sorted((r.sample_id, r["copy"], r.n_values) for r in imaging.image_augment(spark, "").collect())
    assert copies == [(i, c, 224 * 224 * 3) for i, n in ((1, 1), (2, 25), (3, 1)) for c in range(n)]
