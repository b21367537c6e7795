import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import balance, clean, describe, encode, labels, quantiles, split

NAN = float("nan")


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    columns = {"a": rng.normal(size=3001), "b": np.round(rng.exponential(size=3001), 1), "c": np.r_[np.zeros(2999), 5.0, 7.0]}
    df = spark.createDataFrame(pd.DataFrame(columns))
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {(r.column_name, r.probability): r.quantile for r in quantiles.exact_quantiles(quantiles.long_form(df, list(columns)), probabilities).collect()}
    for name, values in columns.items():
        for p in probabilities:
            assert got[name, p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quantiles_small_counts(spark):
    for n in range(1, 9):
        values = [float(v * v) for v in range(n)]
        df = spark.createDataFrame([(v,) for v in [*values, NAN, None]], "a double")
        got = {r.probability: r.quantile for r in quantiles.exact_quantiles(quantiles.long_form(df, ["a"]), (0.25, 0.5, 0.75)).collect()}
        assert got == pytest.approx({p: np.quantile(values, p) for p in (0.25, 0.5, 0.75)})


def test_capping(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (NAN,), (None,), (-9.0,)], "x double")
    got = [r.y for r in df.select(clean.cap(F.col("x"), F.lit(0.0), F.lit(1.5)).alias("y")).collect()]
    assert got == [1.0, 1.5, None, None, 0.0]
    values = [float(v) for v in (*range(1, 21), 500, -500)]
    capped = sorted(r.x for r in clean.iqr_cap(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).collect())
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert capped[0] == pytest.approx(q1 - 1.5 * (q3 - q1)) and capped[-1] == pytest.approx(q3 + 1.5 * (q3 - q1))


def test_capping_fits_elsewhere(spark):
    fit = spark.createDataFrame([(float(v),) for v in range(10)], "x double")
    df = spark.createDataFrame([(1000.0, "k")], "x double, other string")
    row = clean.iqr_cap(df, ["x"], fit_on=fit).first()
    assert row.x == pytest.approx(6.75 + 1.5 * 4.5) and row.other == "k"


def test_risk(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "r long")
    assert [r.b for r in df.select(clean.risk_binarize(F.col("r")).alias("b")).collect()] == [0, 0, 1, 1, 0]


def test_routing(spark):
    df = spark.createDataFrame([], "a double, b string, c long, d boolean, e float, f int, g timestamp")
    assert {r.column_name: r.route for r in describe.dtype_routing(df).collect()} == {"a": "numerical", "b": "categorical", "c": "passthrough", "d": "dropped", "e": "dropped", "f": "passthrough", "g": "dropped"}


def test_missing_report_order(spark):
    df = spark.createDataFrame([(1, None, NAN, 1), (2, None, 1.0, 1), (None, "x", None, 1)], "a long, b string, c double, d int")
    assert [(r.column_name, r.missing_count) for r in describe.missing_report(df).collect()] == [("b", 2), ("c", 2), ("a", 1)]
    assert describe.missing_report(df.limit(0), only_missing=False).first().missing_pct is None


def test_onehot(spark):
    df = spark.createDataFrame([("x",), (None,), ("y",), ("z",)], "c string")
    rows = encode.onehot_drop_first(df, ["c"]).collect()
    assert [r.onehot for r in rows] == [[0, 0], [0, 0], [1, 0], [0, 1]] and rows[0].onehot_names == ["c_y", "c_z"]
    assert encode.onehot_drop_first(spark.createDataFrame([(None,)], "c string"), ["c"]).first().onehot == []


def test_onehot_beyond_the_dense_levels(spark, monkeypatch):
    df = spark.range(1001).select(F.format_string("l%05d", "id").alias("c"), F.lit("k").alias("c_names")).union(spark.createDataFrame([(None, "k")], "c string, c_names string"))
    rows = {r.c: r.onehot for r in encode.onehot_drop_first(df, ["c"]).collect()}
    assert len(rows) == 1002 and sum(rows["l00000"]) == sum(rows[None]) == 0 and rows["l01000"] == [0] * 999 + [1]
    monkeypatch.setattr(encode, "DENSE_LEVELS", 2)
    joined = {r.c: r.onehot for r in encode.onehot_drop_first(df, ["c"]).collect()}
    assert joined == rows
    at = {r.c: r.at for r in encode.onehot_positions(df, "c", "at").collect()}
    assert at["l00000"] == 0 and at["l00741"] == 741 and at[None] is None


def test_standardize(spark):
    train = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (None, 3.0), (NAN, 3.0)], "a double, b double")
    rows = encode.standardize(train, ["a", "b"], encode.standardize_fit(train, ["a", "b"])).collect()
    assert [r.a for r in rows] == [-1.0, 1.0, None, None] and [r.b for r in rows] == [0.0] * 4


def test_split_quota_by_largest_remainder(spark):
    rows = [(i, 1 if i < 51 else 0) for i in range(399)]
    out = split.split_stratified(spark.createDataFrame(rows, "id long, y int"), "id", "y")
    got = {(r.y, r["set"]): r["count"] for r in out.groupBy("y", "set").count().collect()}
    assert got == {(0, "test"): 70, (0, "train"): 278, (1, "test"): 10, (1, "train"): 41}
    again = split.split_stratified(spark.createDataFrame(rows[::-1], "id long, y int").repartition(7), "id", "y")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_batches(spark):
    df = spark.range(130)
    full = split.batch_assign(df, "id", 64)
    assert full.agg(F.countDistinct("batch")).first()[0] == 3 and full.count() == 130
    assert split.batch_assign(df, "id", 64, drop_last=True).groupBy("batch").count().where("count = 64").count() == 2
    assert [tuple(r) for r in split.batch_assign(df, "id", 64, epoch=1).orderBy("id").collect()] != [tuple(r) for r in full.orderBy("id").collect()]
    assert split.sample_random(df, "id", 500).count() == 130


def test_stems(spark):
    names = {"x.y.JPG": "x.y", "a/b/C.png": "c", "plain": "plain", ".hidden": ".hidden", "dir.d/file": "file"}
    df = spark.createDataFrame([(k,) for k in names], "p string")
    assert [r.s for r in df.select(labels.stem(F.col("p")).alias("s")).collect()] == list(names.values())


def test_label_rules(spark):
    df = spark.createDataFrame([(1, 0, "1.JPG"), (1, 7, "1.jpg"), (2, 8, "2.png"), (2, 3, "3.png"), (3, None, "4.png")], "list long, label long, name string").withColumn("n", F.monotonically_increasing_id())
    assert {r.list for r in labels.valid_lists(df, "list", "label").collect()} == {1}
    last = labels.last_per_key(df, labels.stem(F.col("name")), ["n"], ["label"])
    assert {r.stem: r.label for r in last.collect()} == {"1": 7, "2": 8, "3": 3, "4": None}
    assert [r.collapsed for r in labels.collapse(spark.createDataFrame([(0,), (1,), (None,)], "l long"), "l").collect()] == [0, 1, None]
    assert [r.collapsed for r in labels.collapse(spark.createDataFrame([(0,), (7,)], "l long"), "l").collect()] == [0, 1]


def test_last_picture_of_a_stem_counts(spark):
    lines = spark.createDataFrame([("1", 7), ("2", 0), ("3", 1)], "stem string, label long")
    images = spark.createDataFrame([("1", "1.JPG", 10), ("1", "1.jpg", 9), ("2", "2.png", 5), ("4", "4.png", 6)], "stem string, filename string, sample_id long")
    assert sorted((r.stem, r.label, r.sample_id) for r in labels.label_images(lines, images, ["filename", "sample_id"]).collect()) == [("1", 7, 9), ("2", 0, 5)]


def test_cyclic_pairs(spark):
    images, rows = spark.range(3).select(F.col("id").alias("idx"), F.col("id").alias("image")), spark.range(7).select(F.col("id").alias("idx"), F.col("id").alias("record"))
    pairs = labels.cyclic_pairs(images, rows)
    assert {r.image: r["count"] for r in pairs.groupBy("image").count().collect()} == {0: 3, 1: 2, 2: 2}
    assert labels.cyclic_pairs(images.limit(0), rows).count() == 0


def test_balance(spark):
    df = spark.createDataFrame([(1,), (1,), (0,), (0,), (0,)], "y int")
    assert balance.augment_expand(df, "y").count() == 53
    assert balance.class_balance(df, "y").first().ratio == 0.67
    clinical = spark.createDataFrame([(1,)] + [(0,)] * 9, "r int")
    weights = {r.model: r.pos_weight for r in balance.pos_weights(df, "y", clinical, "r").collect()}
    assert weights == {"resnet": 3.0, "vit": 3.0, "hybrid": 1.5, "late_fusion": 3.75, "shared_backbone": 12.0, "boosted_trees": 9.0}
    assert balance.pos_weights(df.where("y = 0"), "y", clinical.where("r = 0"), "r").where("pos_weight is not null").count() == 0
