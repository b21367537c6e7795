"""Classifiers from pyspark.ml, weighted for the rare class, and their persistence."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import forest

#: Settings of the tree models (fixed values): 300 trees; boosting depth 6, step 0.05, 0.8 of the rows, 0.7 of the columns; forest class weights 1 to 4, seed 42. A forest here is at most 30 deep.
TREES, BOOST_DEPTH, BOOST_STEP, BOOST_ROWS, BOOST_COLUMNS, FOREST_WEIGHT, FOREST_DEPTH, SEED = 300, 6, 0.05, 0.8, "0.7", 4.0, 30, 42


def prepared(df: DataFrame, features: str, label: str, positive_weight: float | None = None) -> DataFrame:
    """Add ``vector`` and ``weight``; without a given weight positives weigh negatives / positives."""
    known = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).withColumn("vector", array_to_vector(F.transform(F.col(features), lambda x: x.cast("double"))))
    if positive_weight is None:
        balance = known.agg(F.coalesce(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)), F.lit(1.0)).alias("_w"))
        return known.crossJoin(F.broadcast(balance)).withColumn("weight", F.when(F.col(label) == 1, F.col("_w")).otherwise(1.0)).drop("_w")
    return known.withColumn("weight", F.when(F.col(label) == 1, positive_weight).otherwise(1.0))


def gradient_boosting(trees: int = TREES, depth: int = BOOST_DEPTH) -> GBTClassifier:
    return GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=BOOST_STEP, subsamplingRate=BOOST_ROWS, featureSubsetStrategy=BOOST_COLUMNS, seed=SEED)


def random_forest(trees: int = TREES, depth: int = FOREST_DEPTH) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=SEED)


def logistic_head(regularisation: float = 0.01, iterations: int = 100) -> LogisticRegression:
    """A linear head on frozen features: weighted cross-entropy."""
    return LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", regParam=regularisation, maxIter=iterations)


def mlp_head(inputs: int, hidden: tuple[int, ...] = (512,), iterations: int = 50) -> MultilayerPerceptronClassifier:
    """A hidden-layer head; it takes no weights, so replicate the rare class first."""
    return MultilayerPerceptronClassifier(featuresCol="vector", labelCol="label", layers=[inputs, *hidden, 2], maxIter=iterations, seed=SEED)


def fit_scores(train: DataFrame, test: DataFrame, classifier, key: str, features: str, label: str, positive_weight: float | None = None) -> DataFrame:
    """Fit on ``train``; (key, y, p) on ``test``. Forests are grown and applied in the executors."""
    if isinstance(classifier, RandomForestClassifier):
        return forest.scores(train, test, classifier, key, features, label, positive_weight)
    model = classifier.fit(prepared(train, features, label, positive_weight).withColumn("label", F.col(label).cast("double")))
    scored = model.transform(prepared(test, features, label, 1.0).withColumn("label", F.col(label).cast("double")))
    return scored.select(key, F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    """Any saved model or pipeline: its class stands in its metadata."""
    return DefaultParamsReader.loadParamsInstance(path, SparkSession.getActiveSession())
