"""A random forest grown and applied in the executors, a few trees a task.

The driver holds codes of the rows, one byte a feature, and never a tree: deep
trees on noisy labels have about as many nodes as rows, and hundreds of them
fill any driver. A task grows its trees one after the other from all training rows, scores
the test rows with each and forgets it. Beyond ``CODE_BYTES`` of codes the trees come from
``pyspark.ml`` instead, in groups of few enough nodes.

As there: features are cut into ``bins`` ranges of about equal counts, every tree
draws each row by a Poisson number, every node tries ``tried`` features and splits
where the weighted Gini impurity falls most, two leaves of one prediction become one, and the score is the mean of the trees'
shares of weight in the leaf. Equal input gives equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import materialize

#: Codes of training and test rows that are broadcast at most.
CODE_BYTES = 64_000_000
#: Rows of trees that the driver holds at once where ``pyspark.ml`` grows them: a tree has two nodes a row at most.
DRIVER_ROWS = 400_000
#: Trees a task grows, and relative accuracy of the limits between bins.
TASK_TREES, ACCURACY = 5, 0.001
#: Gain below which a split is rounding.
LEAST_GAIN = 1e-12


def grow(codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, depth: int, tried: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree as (feature, or -1 in a leaf; highest code that goes left; left child, with the right one after it; share of label 1).

    Level by level; the rows of a level's open nodes are sorted by node and code once for each place among
    the features tried, so a level costs as much as it has rows, however many nodes they are in.
    """
    feature, cut, child, share = [], [], [], []
    rows, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
    n, width = 1, codes.shape[1]
    first = 0  # number of the level's first node
    for level in range(depth + 1):
        one = weights * labels
        total, ones = (np.bincount(node, weights=x[rows], minlength=n) for x in (weights, one))
        best_gain, best_feature, best_cut = np.full(n, LEAST_GAIN), np.full(n, -1), np.zeros(n, dtype=np.int64)
        open_ = (ones > 0) & (ones < total)
        keep = open_[node]
        rows, node = rows[keep], node[keep]
        if level < depth and len(rows):
            draws = np.zeros((n, tried), dtype=np.int64)
            draws[open_] = _draws(rng, int(open_.sum()), width, tried)
            impurity = ones * (total - ones) / np.maximum(total, 1e-300)  # half the weighted Gini impurity
            bits = max(1, int(len(rows) - 1).bit_length())
            own = np.arange(len(rows))
            for place in range(draws.shape[1]):
                chosen = draws[:, place]
                code = codes[rows, chosen[node]].astype(np.int64)
                ordered = np.sort((((node << 8) | code) << bits) | own)
                at, key = ordered & ((1 << bits) - 1), ordered >> bits
                ends = np.flatnonzero(key[1:] != key[:-1])  # the last row of each code in a node
                ends = ends[(key[ends] >> 8) == (key[ends + 1] >> 8)]
                if not len(ends):
                    continue
                whose = key[ends] >> 8
                sorted_rows = rows[at]
                sums, sums_one = np.cumsum(weights[sorted_rows]), np.cumsum(one[sorted_rows])
                begins = np.searchsorted(key >> 8, whose)
                before, before_one = (np.where(begins > 0, s[begins - 1], 0.0) for s in (sums, sums_one))
                left, left_one = sums[ends] - before, sums_one[ends] - before_one
                right, right_one = total[whose] - left, ones[whose] - left_one
                gain = (impurity[whose] - left_one * (left - left_one) / left - right_one * (right - right_one) / right) / total[whose]
                order = np.lexsort((-gain, whose))
                lead = order[np.r_[True, whose[order][1:] != whose[order][:-1]]]
                better = gain[lead] > best_gain[whose[lead]]
                lead = lead[better]
                best_gain[whose[lead]], best_feature[whose[lead]], best_cut[whose[lead]] = gain[lead], chosen[whose[lead]], key[ends[lead]] & 255
        split = best_feature >= 0
        following = first + n + 2 * (np.cumsum(split) - 1)
        feature.append(best_feature.astype(np.int16))
        cut.append(best_cut.astype(np.uint8))
        child.append(np.where(split, following, 0))
        share.append(ones / np.maximum(total, 1e-300))
        if not split.any():
            break
        keep = split[node]
        rows, node = rows[keep], node[keep]
        right = codes[rows, best_feature[node]] > best_cut[node]
        node = following[node] - (first + n) + right
        first, n = first + n, 2 * int(split.sum())
    ends = np.cumsum([len(f) for f in feature])
    feature, cut, child, share = (np.concatenate(x) for x in (feature, cut, child, share))
    for begin, end in reversed(list(zip([0, *ends[:-1]], ends))):
        inner = begin + np.flatnonzero(feature[begin:end] >= 0)
        low, high = child[inner], child[inner] + 1
        feature[inner[(feature[low] < 0) & (feature[high] < 0) & ((share[low] > 0.5) == (share[high] > 0.5))]] = -1
    return feature, cut, child, share


def _draws(rng: np.random.Generator, n: int, width: int, tried: int) -> np.ndarray:
    """[n, tried] of 0..width-1, distinct within a row."""
    return np.concatenate([np.argpartition(rng.random((min(n - begin, 65_536), width)), tried - 1, axis=1)[:, :tried] for begin in range(0, n, 65_536)])


def apply(tree: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
    feature, cut, child, share = tree
    at, going = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    while len(going := going[feature[at[going]] >= 0]):
        here = at[going]
        at[going] = child[here] + (codes[going, feature[here]] > cut[here])
    return share[at]


def limits_of(rows: DataFrame, features: str, width: int, bins: int) -> list[np.ndarray]:
    """Upper limits of all bins but the last, for each feature."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get(features, F.lit(i)), at, round(1 / ACCURACY)).alias(f"q{i}") for i in range(width)]).first()
    return [np.unique(np.array(q or [], dtype=np.float64)) for q in found]


def _coded(rows: DataFrame, key: str, features: str, label: str, limits: list[np.ndarray]) -> DataFrame:
    """(keys, codes, labels): an Arrow batch's rows as one row of three values."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(features).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = np.stack([np.searchsorted(q, x[:, i], side="left") for i, q in enumerate(limits)], axis=1).astype(np.uint8)
            labels = batch.column(label).to_numpy(zero_copy_only=False).astype(np.uint8)
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(key))
            yield pa.RecordBatch.from_arrays([keys, pa.array([codes.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary())], names=["keys", "codes", "labels"])

    return rows.select(key, features, label).mapInArrow(run, f"keys array<{kind}>, codes binary, labels binary")


def scores(train: DataFrame, test: DataFrame, classifier: RandomForestClassifier, key: str, features: str, label: str, positive_weight: float | None = None) -> DataFrame:
    """(key, y, p) of the test rows by a forest with the classifier's settings. Rows without features or label are left out; without a given weight positives weigh negatives / positives."""
    spark = train.sparkSession
    usable = lambda df: df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(key, F.transform(features, lambda x: x.cast("double")).alias(features), F.col(label).cast("int").alias(label))
    train, test = usable(train), usable(test)
    counted = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("width"), F.coalesce(F.sum(label), F.lit(0)).alias("ones")).first()
    if positive_weight is None:
        positive_weight = (counted["n"] - counted["ones"]) / counted["ones"] if counted["ones"] else 1.0
    n_test = test.count()
    if not counted["n"] or (counted["n"] + n_test) * counted["width"] > CODE_BYTES:
        return _in_groups(train, test, classifier, key, features, label, positive_weight, counted["n"])
    width, trees, depth, seed = counted["width"], classifier.getNumTrees(), classifier.getMaxDepth(), classifier.getSeed()
    tried = max(1, math.ceil(math.sqrt(width)))
    limits = limits_of(train, features, width, classifier.getMaxBins())
    # rows in the order of their keys, so that the draws do not depend on how the table is cut
    blobs = [_gathered(_coded(df, key, features, label, limits).collect(), width) for df in (train, test)]
    (_, codes, labels), (keys, test_codes, test_labels) = blobs
    shared = spark.sparkContext.broadcast((codes, labels, test_codes))  # CODE_BYTES at most
    tasks = -(-trees // TASK_TREES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, y, asked = shared.value
        for batch in batches:
            for task in batch.column("id").to_pylist():
                votes = np.zeros(len(asked))
                for number in range(task * TASK_TREES, min(trees, (task + 1) * TASK_TREES)):
                    rng = np.random.default_rng([seed, number])
                    times = rng.poisson(1.0, len(known))
                    drawn = np.flatnonzero(times)
                    weights = times[drawn] * np.where(y[drawn] == 1, positive_weight, 1.0)
                    votes += apply(grow(known[drawn], y[drawn].astype(np.float64), weights, depth, tried, rng), asked)
                for begin in range(0, len(votes), 100_000):
                    part = votes[begin : begin + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin, begin + len(part))), pa.array(np.full(len(part), task)), pa.array(part)], names=["place", "task", "votes"])

    voted = spark.range(0, tasks, 1, tasks).mapInArrow(run, "place long, task long, votes double")
    # added in the order of the tasks, so that equal input gives equal scores
    mean = F.aggregate(F.array_sort(F.collect_list(F.struct("task", "votes"))), F.lit(0.0), lambda s, x: s + x["votes"]) / trees
    summed = materialize(voted.groupBy("place").agg(mean.alias("p")), "votes")
    named = spark.createDataFrame(pa.table({"place": np.arange(len(keys)), key: keys, "y": test_labels.astype(np.int32)}))
    return named.join(summed, "place").select(key, "y", "p")


def _gathered(rows: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, codes and labels, by key."""
    keys = np.array([k for r in rows for k in r["keys"]])
    codes = np.frombuffer(b"".join(r["codes"] for r in rows), dtype=np.uint8).reshape(-1, width)
    labels = np.frombuffer(b"".join(r["labels"] for r in rows), dtype=np.uint8)
    order = np.argsort(keys, kind="stable")
    return keys[order], codes[order], labels[order]


def _in_groups(train: DataFrame, test: DataFrame, classifier: RandomForestClassifier, key: str, features: str, label: str, positive_weight: float, n: int) -> DataFrame:
    """The forest in groups of trees by ``pyspark.ml``, each scored and forgotten before the next."""
    from cohortlab.operators.models import prepared

    fitted, asked = (prepared(df, features, label, w).withColumn("label", F.col(label).cast("double")) for df, w in ((train, positive_weight), (test, 1.0)))
    total, size = classifier.getNumTrees(), max(1, DRIVER_ROWS // max(n, 1))
    votes = None
    for begin in range(0, total, size):
        few = min(size, total - begin)
        model = classifier.copy({classifier.numTrees: few, classifier.seed: classifier.getSeed() + begin}).fit(fitted)
        part = materialize(model.transform(asked).select(key, F.col("label").cast("int").alias("y"), (vector_to_array("probability")[1] * few).alias("p")), "group")
        votes = part if votes is None else materialize(votes.unionByName(part).groupBy(key, "y").agg(F.sum("p").alias("p")), "votes")
    return votes.select(key, "y", (F.col("p") / total).alias("p"))
