"""Binary and multiclass metrics over scores.

Scores are a table (model, y, p). They are read once: counted per distinct
score and range-partitioned by it. Counts at any number of thresholds and the
curves are both derived from that table; curves accumulate inside each range
and add counted offsets, so no task holds all scores, wherever they crowd.

Defined results: rows without truth or score, or with a NaN score, are left
out; ties count half in the area and are one step in average precision; ratios
without a denominator are 0, the area of a single class is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.session import materialize

THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def score_counts(scores: DataFrame, **more: Column) -> DataFrame:
    """(model, p, pos, neg) per distinct score, written once, with the range ``_bucket`` of equal sizes it lies in; ``more`` are further aggregates."""
    known = scores.where(F.col("y").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p"))
    counts = known.groupBy("model", "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), *[c.alias(n) for n, c in more.items()])
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(counts.repartitionByRange(parts, F.col("model"), F.desc("p")).withColumn("_bucket", F.spark_partition_id()), "scores")


def confusion(counts: DataFrame, thresholds: Sequence[float] = THRESHOLDS, strict: bool = False) -> DataFrame:
    """(model, threshold, tn, fp, fn, tp) from ``score_counts``; a score equal to the threshold is positive unless ``strict``."""
    cells = []
    for t in thresholds:
        hit = F.col("p") > t if strict else F.col("p") >= t
        cells.append(F.struct(F.lit(float(t)).alias("threshold"), *[F.sum(F.when(hit, F.col(side)).otherwise(0)).alias(name) for name, side in (("tp", "pos"), ("fp", "neg"))]))
    totals = counts.groupBy("model").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"), F.array(*cells).alias("_cells"))
    per = totals.select("model", "_pos", "_neg", F.explode("_cells").alias("_c"))
    return per.select("model", "_c.threshold", (F.col("_neg") - F.col("_c.fp")).alias("tn"), F.col("_c.fp").alias("fp"), (F.col("_pos") - F.col("_c.tp")).alias("fn"), F.col("_c.tp").alias("tp"))


def rates(counts: DataFrame) -> DataFrame:
    """Add accuracy, recall, precision, f1 and specificity; each is 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "recall": ratio(tp, tp + fn),
            "precision": ratio(tp, tp + fp),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "specificity": ratio(tn, tn + fp),
        }
    )


def curve(counts: DataFrame) -> DataFrame:
    """(model, p, pos, neg, tp, fp, all_pos, all_neg) per distinct score of ``score_counts``: tp and fp count the scores of at least p."""
    sums = counts.groupBy("model", "_bucket").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy("model").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("model")  # at most a row per shuffle partition
    offsets = sums.select(
        "model", "_bucket", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_fp"), F.sum("_p").over(everything).alias("all_pos"), F.sum("_n").over(everything).alias("all_neg")
    )
    inside = Window.partitionBy("model", "_bucket").orderBy(F.desc("p"))
    counted = counts.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)}).join(offsets, ["model", "_bucket"])
    return counted.select("model", "p", "pos", "neg", (F.col("tp") + F.col("_tp")).alias("tp"), (F.col("fp") + F.col("_fp")).alias("fp"), "all_pos", "all_neg")


def ranking_metrics(counts: DataFrame) -> DataFrame:
    """(model, roc_auc, average_precision) from ``score_counts``. The area counts ties half and is null for a single class; average precision is the step sum, 0 without positives."""
    area = F.sum((F.col("neg") * (F.col("tp") - F.col("pos") / 2)).cast("double"))
    step = F.sum(ratio(F.col("pos"), F.col("all_pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return curve(counts).groupBy("model").agg(F.try_divide(area, F.max(F.col("all_pos").cast("double") * F.col("all_neg"))).alias("roc_auc"), step.alias("average_precision"))


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float] = THRESHOLDS, strict: bool = False) -> DataFrame:
    """One row per model and threshold with all metrics; scores are worked out once."""
    counts = score_counts(scores)
    return rates(confusion(counts, thresholds, strict)).join(ranking_metrics(counts), "model")


def confusion_cells(counts: DataFrame) -> DataFrame:
    """Long form: (model, threshold, actual, predicted, n)."""
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(c).alias("n")) for a, b, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))]
    return counts.select("model", "threshold", F.explode(F.array(*cells)).alias("_c")).select("model", "threshold", "_c.*")


METRICS = ("accuracy", "recall", "precision", "f1", "roc_auc", "average_precision", "specificity")


def tidy(table: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Long form: (model, threshold, ordinal, metric, score) in a fixed order of metrics."""
    cells = [F.struct(F.lit(i).alias("ordinal"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for i, m in enumerate(metrics)]
    return table.select("model", "threshold", F.explode(F.array(*cells)).alias("_c")).select("model", "threshold", "_c.*")


def classification_report(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(class_name, precision, recall, f1, support): both classes, accuracy, macro and weighted averages, four digits."""
    c = confusion(score_counts(scores), [threshold])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = (tp + fp + fn + tn).cast("double")
    neg = (ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fn + fp), tn + fp)
    pos = (ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fn + fp), tp + fn)
    accuracy = ratio(tp + tn, tp + fp + fn + tn)
    macro = [(a + b) / 2 for a, b in zip(neg[:3], pos[:3])]
    weighted = [ratio(a * neg[3] + b * pos[3], n) for a, b in zip(neg[:3], pos[:3])]
    lines = {"0": neg, "1": pos, "accuracy": (accuracy, accuracy, accuracy, n), "macro avg": (*macro, n), "weighted avg": (*weighted, n)}
    rows = [F.struct(F.lit(name).alias("class_name"), *[F.round(v, 4).alias(k) for k, v in zip(("precision", "recall", "f1"), line)], line[3].cast("long").alias("support")) for name, line in lines.items()]
    return c.select("model", F.explode(F.array(*rows)).alias("_r")).select("model", "_r.*")


def argmax(values: Column) -> Column:
    """Position of the first maximum, from 0."""
    return F.array_position(values, F.array_max(values)) - 1


def multiclass_macro(scores: DataFrame, label: str, probabilities: str, classes: int) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1 of the largest probability, macro one-vs-rest area and average precision. All of it from one count per class and distinct score."""
    known = scores.where(F.col(label).isNotNull() & F.col(probabilities).isNotNull()).withColumn("_pred", argmax(F.col(probabilities)))
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.struct(c.alias("model"), F.get(F.col(probabilities), c).alias("p")))).alias("_e")
    long = known.select(F.col(label).alias("_y"), "_pred", each).select(F.col("_e.model").alias("model"), (F.col("_y") == F.col("_e.model")).cast("int").alias("y"), F.col("_e.p").alias("p"), (F.col("_pred") == F.col("_e.model")).alias("hit"))
    counts = score_counts(long, hits=F.count_if(F.col("hit") & (F.col("y") == 1)), named=F.count_if("hit"))
    per = counts.groupBy("model").agg(F.sum("hits").alias("tp"), F.sum("named").alias("said"), F.sum("pos").alias("have"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    return per.join(ranking_metrics(counts), "model").agg(
        ratio(F.sum("tp"), F.max("n")).alias("accuracy"),
        F.avg(ratio(F.col("tp"), F.col("said"))).alias("macro_precision"),
        F.avg(ratio(F.col("tp"), F.col("have"))).alias("macro_recall"),
        F.avg(ratio(2 * F.col("tp"), F.col("said") + F.col("have"))).alias("macro_f1"),
        F.avg("roc_auc").alias("macro_roc_auc"),
        F.avg("average_precision").alias("macro_average_precision"),
    )
