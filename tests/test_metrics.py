import numpy as np
import pandas as pd
import pytest

from cohortlab.operators import metrics


def scores(spark, y, p, model="m"):
    return spark.createDataFrame(pd.DataFrame({"model": model, "y": np.asarray(y, dtype="int32"), "p": np.asarray(p, dtype=float)}))


def naive_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


def naive_ap(y, p):
    total, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = (y[hit] == 1).sum() / (y == 1).sum()
        total, last = total + (recall - last) * (y[hit] == 1).mean(), recall
    return total


@pytest.mark.parametrize("digits", [1, 2, 9])
def test_curve_metrics(spark, digits):
    rng = np.random.default_rng(digits)
    y = (rng.random(700) < 0.2).astype(int)
    p = np.round(np.clip(rng.random(700) * 0.7 + 0.3 * y, 0, 1), digits)
    row = metrics.ranking_metrics(metrics.score_counts(scores(spark, y, p))).first()
    assert row.roc_auc == pytest.approx(naive_auc(y, p)) and row.average_precision == pytest.approx(naive_ap(y, p))


def test_thresholds(spark):
    rng = np.random.default_rng(3)
    y, p = (rng.random(500) < 0.4).astype(int), np.round(rng.random(500), 1)
    for strict in (False, True):
        rows = metrics.threshold_sweep(scores(spark, y, p), strict=strict).orderBy("threshold").collect()
        for r in rows:
            hit = p > r.threshold if strict else p >= r.threshold
            assert (r.tp, r.fp, r.fn, r.tn) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum())
            assert r.tp + r.fp + r.fn + r.tn == 500
        assert all(a.recall >= b.recall for a, b in zip(rows, rows[1:]))


def test_edges(spark):
    row = metrics.threshold_sweep(scores(spark, [0, 0], [0.2, 0.9]), [0.5]).first()
    assert (row.recall, row.specificity, row.roc_auc, row.precision, row.f1) == (0.0, 0.5, None, 0.0, 0.0)
    row = metrics.threshold_sweep(scores(spark, [1, 0], [0.5, 0.1]), [0.5]).first()
    assert row.tp == 1
    assert metrics.confusion(metrics.score_counts(scores(spark, [1], [0.5])), [0.5], strict=True).first().tp == 0
    row = metrics.threshold_sweep(scores(spark, [1, 0], [0.2, 0.1]), [0.5]).first()
    assert (row.precision, row.f1) == (0.0, 0.0)
    assert metrics.threshold_sweep(scores(spark, [1], [0.5]).limit(0)).count() == 0


def test_missing_scores_are_left_out(spark):
    df = spark.createDataFrame([("m", 1, 0.9), ("m", None, 0.9), ("m", 0, None), ("m", 0, float("nan")), ("m", 0, 0.1)], "model string, y int, p double")
    row = metrics.confusion(metrics.score_counts(df), [0.5]).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (1, 0, 0, 1)


def test_report_and_multiclass(spark):
    y, p = [0, 0, 1, 1, 1], [0.1, 0.8, 0.9, 0.7, 0.2]
    rows = {r.class_name: r for r in metrics.classification_report(scores(spark, y, p)).collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["0"].support, rows["accuracy"].f1) == (0.6667, 0.6667, 2, 0.6)
    df = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (1, [0.2, 0.5, 0.3]), (2, [0.5, 0.1, 0.4]), (1, [0.4, 0.4, 0.2])], "y int, q array<double>")
    row = metrics.multiclass_macro(df, "y", "q", 3).first()
    assert row.accuracy == 0.5 and row.macro_recall == pytest.approx((1 + 0.5 + 0) / 3)
