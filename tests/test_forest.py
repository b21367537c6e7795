import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.operators import forest, models


def test_a_tree_splits_where_the_impurity_falls_most():
    codes = np.array([[3, 0], [3, 1], [5, 0], [5, 1], [7, 0], [7, 1]], dtype=np.uint8)
    labels = np.array([0, 0, 1, 1, 0, 0], dtype=float)
    tree = forest.grow(codes, labels, np.ones(6), 30, 2, np.random.default_rng(0))
    assert forest.apply(tree, codes).tolist() == labels.tolist()
    assert forest.apply(forest.grow(codes, labels, np.ones(6), 0, 2, np.random.default_rng(0)), codes).tolist() == [1 / 3] * 6
    # no split lowers the impurity: one leaf; leaves of one prediction are merged
    assert forest.grow(codes[:, :1] * 0, labels, np.ones(6), 30, 1, np.random.default_rng(0))[0].tolist() == [-1]
    merged = forest.grow(np.array([[0], [0], [0], [1]], dtype=np.uint8), np.array([0.0, 0, 1, 0]), np.ones(4), 30, 1, np.random.default_rng(0))
    assert merged[0][0] == -1 and merged[3][0] == 0.25


def table(spark, n):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        x = rng.normal(size=6)
        rows.append((i, x.tolist(), int(x[0] + x[1] * x[2] + 0.5 * rng.normal() > 0.8)))
    return spark.createDataFrame(rows, "id long, x array<double>, y int")


def auc(df):
    rows = df.toPandas()
    one, zero = rows.p[rows.y == 1].to_numpy(), rows.p[rows.y == 0].to_numpy()
    return (one[:, None] > zero[None]).mean() + (one[:, None] == zero[None]).mean() / 2


def test_the_driver_never_holds_the_forest(spark, monkeypatch):
    df = table(spark, 600)
    train, test = df.where("id < 400"), df.where("id >= 400")
    fit = models.RandomForestClassifier.fit
    sizes = []
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, *a: sizes.append(self.getNumTrees()) or fit(self, *a))
    classifier = models.random_forest(trees=30, depth=12)
    here = models.fit_scores(train, test, classifier, "id", "x", "y", 4.0)
    assert sizes == [] and sorted(r.id for r in here.collect()) == list(range(400, 600))
    again = models.fit_scores(train.repartition(5), test, classifier, "id", "x", "y", 4.0)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, here.collect()))
    # beyond the bound: groups of trees, all of them
    monkeypatch.setattr(forest, "CODE_BYTES", 10)
    monkeypatch.setattr(forest, "DRIVER_ROWS", 400 * 14)
    grouped = models.fit_scores(train, test, classifier, "id", "x", "y", 4.0)
    assert sizes == [14, 14, 2] and grouped.count() == 200
    assert auc(here) > 0.8 and auc(here) == pytest.approx(auc(grouped), abs=0.05)
    assert here.join(grouped.withColumnRenamed("p", "q"), "id").agg(F.avg(F.abs(F.col("p") - F.col("q")))).first()[0] < 0.08
