"""The registered training queries use the full settings."""

from cohortlab.operators import models
from cohortlab.plans import evaluation


def test_tree_queries_use_the_full_settings(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "_trained", lambda spark, folder, classifier, weight=None: (classifier, weight))
    forest, weight = evaluation.train_random_forest(spark, "")
    boosted, _ = evaluation.train_gbt(spark, "")
    assert (forest.getNumTrees(), forest.getMaxDepth(), weight) == (models.TREES, models.FOREST_DEPTH, models.FOREST_WEIGHT) == (300, 30, 4.0)
    assert (boosted.getMaxIter(), boosted.getMaxDepth()) == (models.TREES, models.BOOST_DEPTH) == (300, 6)
