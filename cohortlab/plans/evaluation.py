"""Queries of metrics, scoring, losses and models."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import balance, labels, losses, metrics, models, networks, scoring, split
from cohortlab.plans.common import position_sum, read, rounded, sine_weights
from cohortlab.session import materialize

PHASES = {"head_a": 0, "head_b": 100, "head_c": 200}
CLASSES, WIDTH, CLINICAL = 10, 64, 32


def head(spark: SparkSession, folder: str, name: str = "head_a") -> DataFrame:
    """(vec_id, y, z, p) of a linear head on the feature vectors; class 7 is positive, 8 and 9 are undefined."""
    rows = read(spark, folder, "embeddings").select("vec_id", labels.binary_label(F.col("label")).alias("y"), "embedding")
    return scoring.with_scores(rows, "embedding", sine_weights(WIDTH, PHASES[name])).select("vec_id", "y", "z", "p")


def scores(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    parts = [head(spark, folder, n).select(F.lit(n).alias("model"), "y", "p") for n in names or ("head_a",)]
    return reduce(DataFrame.unionByName, parts)


def threshold_sweep(spark, folder):
    return rounded(metrics.threshold_sweep(scores(spark, folder)))


def confusion_by_threshold(spark, folder):
    return metrics.confusion_cells(metrics.confusion(metrics.score_counts(scores(spark, folder)), strict=True))


def roc_auc(spark, folder):
    return rounded(metrics.ranking_metrics(metrics.score_counts(scores(spark, folder, *PHASES))).select("model", "roc_auc"))


def average_precision(spark, folder):
    return rounded(metrics.ranking_metrics(metrics.score_counts(scores(spark, folder, *PHASES))).select("model", "average_precision"))


def classification_report(spark, folder):
    return rounded(metrics.classification_report(scores(spark, folder)), 4)


def model_comparison(spark, folder):
    return rounded(metrics.tidy(metrics.threshold_sweep(scores(spark, folder, *PHASES), [0.5])))


def _softmax(spark, folder):
    logits = F.array(*[scoring.linear(F.col("embedding"), sine_weights(WIDTH, WIDTH * c)) for c in range(CLASSES)])
    return read(spark, folder, "embeddings").select("vec_id", "label", scoring.softmax(logits).alias("probabilities"))


def multiclass_macro(spark, folder):
    return rounded(metrics.multiclass_macro(_softmax(spark, folder), "label", "probabilities", CLASSES))


def linear_sigmoid_score(spark, folder):
    return rounded(head(spark, folder).select("vec_id", "z", "p"))


def clinical_vectors(spark, folder):
    """Usable rows of the clinical matrix: whole length, no missing component."""
    rows = read(spark, folder, "dl_train_data").where(F.size("x_train") == CLINICAL)
    return rows.where(~F.exists("x_train", lambda x: x.isNull() | F.isnan(x))).select("vec_id", F.transform("x_train", lambda x: x.cast("double")).alias("x"), "y_train")


def _layers(widths, inputs, phase):
    """Formula weights of consecutive layers."""
    return [scoring.formula_weights(n, m, phase + 10 * i) for i, (n, m) in enumerate(zip(widths, (inputs, *widths)))]


ENCODER = _layers(scoring.SHARED["clinical"], CLINICAL, 0)
BACKBONE, CLASSIFIER = _layers(scoring.SHARED["backbone"], scoring.SHARED["clinical"][-1], 40), scoring.formula_weights(1, scoring.SHARED["backbone"][-1], 60)
PROJECTION = scoring.formula_weights(scoring.SHARED["image"][1], scoring.SHARED["image"][0], 30)
MODALITIES = {"clinical": ENCODER, "image": [PROJECTION]}


def tiled(features, width, size):
    """The first ``width`` features repeated up to ``size``: a stand-in for features of the networks' true width."""
    return F.slice(F.flatten(F.array_repeat(F.slice(features, 1, width), -(-size // width))), 1, size)


def clinical_mlp_forward(spark, folder):
    """The encoder at its true widths; of 512 outputs the first four and the position-weighted sum of all."""
    encode = scoring.network(ENCODER, relu_last=True)

    @F.pandas_udf("array<double>")
    def forward(x: pd.Series) -> pd.Series:
        return pd.Series(list(encode(np.stack(x.to_numpy()).astype(float)))) if len(x) else pd.Series([], dtype=object)

    out = clinical_vectors(spark, folder).select("vec_id", forward("x").alias("f"))
    return rounded(out.select("vec_id", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(4)], position_sum("f").alias("position_sum")))


def _shared_logit(rows, features, name):
    return rounded(rows.select("vec_id", scoring.shared_backbone(features, scoring.modality(name, MODALITIES), BACKBONE, CLASSIFIER).alias("logit")))


def uml_forward_clinical(spark, folder):
    return _shared_logit(clinical_vectors(spark, folder), F.col("x"), "clinical")


def _image_rows(spark, folder):
    return read(spark, folder, "embeddings").select("vec_id", labels.binary_label(F.col("label")).alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def uml_forward_image(spark, folder):
    return _shared_logit(_image_rows(spark, folder), tiled(F.col("e"), WIDTH, scoring.SHARED["image"][0]), "image")


def uml_image_evaluation(spark, folder):
    """The shared model's image path against the image labels, at all thresholds."""
    rows = _image_rows(spark, folder)
    logit = scoring.shared_backbone(tiled(F.col("e"), WIDTH, scoring.SHARED["image"][0]), MODALITIES["image"], BACKBONE, CLASSIFIER)
    scored = rows.where("y is not null").select(F.lit("shared_image").alias("model"), "y", F.round(scoring.sigmoid(logit), 9).alias("p"))
    return rounded(metrics.threshold_sweep(scored))


def late_fusion_forward(spark, folder):
    image, clinical = scoring.LATE_FUSION["image"], scoring.LATE_FUSION["clinical"]
    logits = scoring.late_fusion(
        tiled(F.col("x"), 24, image), F.col("x"), _layers(clinical, CLINICAL, 0),
        scoring.formula_weights(1, image, 70), scoring.formula_weights(1, clinical[-1], 80), scoring.formula_weights(scoring.LATE_FUSION["fusion"], image + clinical[-1], 90), scoring.formula_weights(1, scoring.LATE_FUSION["fusion"], 95),
    )
    return rounded(clinical_vectors(spark, folder).select("vec_id", logits.alias("l")).select("vec_id", "l.*"))


def _head_forward(spark, folder, name, phase):
    size, hidden, _ = scoring.HEADS[name]
    run = scoring.network([scoring.formula_weights(hidden, size, phase), scoring.formula_weights(1, hidden, phase + 10)], relu_last=False)

    @F.pandas_udf("double")
    def forward(x: pd.Series) -> pd.Series:
        return pd.Series(run(np.stack(x.to_numpy()).astype(float))[:, 0] if len(x) else [], dtype="float64")

    return rounded(_image_rows(spark, folder).select("vec_id", forward(tiled(F.col("e"), WIDTH, size)).alias("logit")))


def resnet_head_forward(spark, folder):
    return _head_forward(spark, folder, "resnet", 200)


def vit_head_forward(spark, folder):
    return _head_forward(spark, folder, "vit", 230)


def hybrid_forward(spark, folder):
    """The hybrid at its true widths; token t of a picture is its vector turned by t places and repeated to the feature width."""
    size = scoring.HYBRID
    parts = scoring.hybrid_parts(size["features"], size["model"], size["forward"], size["layers"], size["tokens"])
    shared = spark.sparkContext.broadcast(parts)  # the model, whose size the data do not change

    @F.pandas_udf("double")
    def forward(e: pd.Series) -> pd.Series:
        out = []
        for begin in range(0, len(e), 32):
            x = np.stack(e.iloc[begin : begin + 32].to_numpy()).astype(float)
            tokens = np.stack([np.tile(np.roll(x, -t, axis=1), (1, size["features"] // WIDTH)) for t in range(size["tokens"])], axis=1)
            out.append(scoring.hybrid_logits(tokens, shared.value, size["heads"]))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return rounded(_image_rows(spark, folder).select("vec_id", forward("e").alias("logit")), 5)


def layernorm_meanpool(spark, folder):
    rows = read(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    rows = rows.select("vec_id", scoring.layer_norm(scoring.mean_pool(scoring.tokens_of(F.col("e"), 16), 16, skip_first=True)).alias("f"))
    return rounded(rows.select("vec_id", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(16)]), 5)


def _known(spark, folder, name="head_a"):
    return head(spark, folder, name).where("y is not null")


def bce_pos_weight(spark, folder):
    return rounded(_known(spark, folder).select("vec_id", losses.bce(F.col("z"), F.col("y"), 2.5).alias("loss")))


def focal_loss(spark, folder):
    return rounded(_known(spark, folder).select("vec_id", losses.focal(F.col("z"), F.col("y")).alias("loss")))


def composite_loss(spark, folder):
    z = [scoring.linear(F.col("embedding"), sine_weights(WIDTH, p)) for p in PHASES.values()]
    rows = read(spark, folder, "embeddings").select("vec_id", labels.binary_label(F.col("label")).alias("y"), *[c.alias(f"z{i}") for i, c in enumerate(z)]).where("y is not null")
    parts = [losses.bce(F.col(f"z{i}"), F.col("y")) for i in range(3)]
    return rounded(rows.select("vec_id", losses.composite(*parts).alias("late_fusion"), losses.composite(*parts[:2]).alias("shared_backbone")))


def _batched_loss(spark, folder):
    rows = _known(spark, folder).select("vec_id", losses.bce(F.col("z"), F.col("y")).alias("loss"))
    return split.batch_assign(rows, "vec_id", 64)


def epoch_loss_weighted(spark, folder):
    return rounded(losses.epoch_weighted(_batched_loss(spark, folder), "batch", "loss"))


def epoch_loss_batch_mean(spark, folder):
    return rounded(losses.epoch_batch_mean(_batched_loss(spark, folder), "batch", "loss"))


def batch_assign(spark, folder):
    return split.batch_assign(read(spark, folder, "dl_train_data").select("vec_id"), "vec_id", 64, epoch=3, drop_last=True)


def _split_vectors(spark, folder):
    """Usable vectors with their set, written once: models are fitted on them and score them."""
    return materialize(split.split_stratified(clinical_vectors(spark, folder).where("y_train is not null"), "vec_id", "y_train"), "split")


def _trained(spark, folder, classifier, positive_weight=None):
    rows = _split_vectors(spark, folder)
    fitted = models.fit_scores(rows.where("set = 'train'"), rows.where("set = 'test'"), classifier, "vec_id", "x", "y_train", positive_weight)
    return metrics.threshold_sweep(fitted.select(F.lit(type(classifier).__name__).alias("model"), "y", "p"))


def train_logistic_head(spark, folder):
    return _trained(spark, folder, models.logistic_head())


def train_random_forest(spark, folder):
    return _trained(spark, folder, models.random_forest(), models.FOREST_WEIGHT)


def train_gbt(spark, folder):
    return _trained(spark, folder, models.gradient_boosting())


def _paired(spark, folder):
    """Split pictures and clinical vectors, and their unpaired training pairs, all written once."""
    images = materialize(split.split_stratified(_image_rows(spark, folder).where("y is not null"), "vec_id", "y"), "image-split")
    clinical = _split_vectors(spark, folder)
    sides = []
    for rows, feature, label, name in ((images, "e", "y", "image"), (clinical, "x", "y_train", "clinical")):
        train = rows.where("set = 'train'").select("vec_id", F.col(feature).alias(name), F.col(label).cast("int").alias(f"y_{name}"))
        sides.append(split.ordered_positions(train, split.draw(1, F.col("vec_id")), "idx").drop("vec_id"))
    return images, clinical, materialize(labels.cyclic_pairs(*sides), "pairs")


def _weight(model, *tables):
    """factor · negatives / positives over the training rows of the tables."""
    counts = [t.where("set = 'train'").agg(F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)).first() for t, y in tables]
    return balance.POS_WEIGHT_FACTORS[model] * sum(c[0] for c in counts) / max(sum(c[1] for c in counts), 1)


def train_late_fusion(spark, folder):
    """Late fusion trained as one network on unpaired pairs; each head on its modality's test rows, fusion on pairs of test rows, against the image label."""
    images, clinical, pairs = _paired(spark, folder)
    network = networks.LateFusion(WIDTH, CLINICAL, scoring.LATE_FUSION["clinical"], scoring.LATE_FUSION["fusion"])
    weights = networks.train(pairs, network, "pair", "image", "clinical", "y_image", "y_clinical", _weight("late_fusion", (images, "y")))
    tests = [split.ordered_positions(t.where("set = 'test'").select("vec_id", F.col(x).alias(name), F.col(y).cast("int").alias(f"y_{name}")), split.draw(1, F.col("vec_id")), "idx").drop("vec_id") for t, x, y, name in ((images, "e", "y", "image"), (clinical, "x", "y_train", "clinical"))]
    scored = materialize(networks.scored(labels.cyclic_pairs(*tests), network, weights, "image", "clinical", ["pair", "y_image", "y_clinical"]), "scored")
    parts = [scored.select(F.lit(n).alias("model"), F.col("y_clinical" if n == "clinical" else "y_image").alias("y"), F.col(f"p_{n}").alias("p")) for n in ("image", "clinical", "fusion")]
    return metrics.threshold_sweep(reduce(DataFrame.unionByName, parts))


def train_shared_backbone(spark, folder):
    """The shared backbone trained on both projected modalities, weighted by the classes of both; each modality's test rows."""
    images, clinical, pairs = _paired(spark, folder)
    network = networks.SharedBackbone(WIDTH, CLINICAL, scoring.SHARED["clinical"], scoring.SHARED["image"][1], scoring.SHARED["backbone"])
    weights = networks.train(pairs, network, "pair", "image", "clinical", "y_image", "y_clinical", _weight("shared_backbone", (images, "y"), (clinical, "y_train")))
    image = networks.scored(images.where("set = 'test'").select(F.col("e").alias("image"), "y"), network, weights, "image", None, ["y"]).select(F.lit("image").alias("model"), "y", F.col("p_image").alias("p"))
    other = networks.scored(clinical.where("set = 'test'").select(F.col("x").alias("clinical"), F.col("y_train").cast("int").alias("y")), network, weights, None, "clinical", ["y"]).select(F.lit("clinical").alias("model"), "y", F.col("p_clinical").alias("p"))
    return metrics.threshold_sweep(image.unionByName(other))


QUERIES = {
    f.__name__: f
    for f in (
        threshold_sweep, confusion_by_threshold, roc_auc, average_precision, classification_report, model_comparison, multiclass_macro,
        linear_sigmoid_score, clinical_mlp_forward, uml_forward_clinical, uml_forward_image, uml_image_evaluation, late_fusion_forward,
        resnet_head_forward, vit_head_forward, hybrid_forward, layernorm_meanpool,
        bce_pos_weight, focal_loss, composite_loss, epoch_loss_weighted, epoch_loss_batch_mean, batch_assign,
        train_logistic_head, train_random_forest, train_gbt, train_late_fusion, train_shared_backbone,
    )
}

# ---- SQL --------------------------------------------------------------------

_Y = "case when label = 7 then 1 when label between 0 and 6 then 0 end"


def _z(phase: int, vector: str = "embedding::double[]", n: int = WIDTH) -> str:
    return f"list_dot_product({vector}, list_transform(range({n}), lambda i: sin(i + {1 + phase})))"


_SCORES = "with s as (" + " union all ".join(f"select vec_id, '{n}' as model, {_Y} as y, {_z(p)} as z, 1 / (1 + exp(-({_z(p)}))) as p from embeddings" for n, p in PHASES.items()) + "), known as (select * from s where y is not null)"
_CURVE = """,
    per as (select model, p, sum(y) as pos, sum(1 - y) as neg from known group by all),
    cum as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model) as all_pos, sum(neg) over (partition by model) as all_neg from per window w as (partition by model order by p desc)),
    area as (select model, sum(neg * (tp - pos / 2)) / max(all_pos * all_neg) as roc_auc, sum(pos / all_pos * tp / (tp + fp)) as average_precision from cum group by model)
"""
_COUNTS = """,
    cnt as (
        select model, threshold::double as threshold, count(*) filter (p < threshold and y = 0) as tn, count(*) filter (p >= threshold and y = 0) as fp,
            count(*) filter (p < threshold and y = 1) as fn, count(*) filter (p >= threshold and y = 1) as tp
        from known cross join (select unnest([0.1, 0.2, 0.3, 0.4, 0.5]::double[]) as threshold) group by all
    ),
    rate as (
        select *, (tp + tn) / (tp + tn + fp + fn) as accuracy, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(tp / nullif(tp + fp, 0), 0) as "precision",
            coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, coalesce(tn / nullif(tn + fp, 0), 0) as specificity
        from cnt
    )
"""


def _dense(out: str, before: str, outputs: int, inputs: int, phase: int, relu: bool = True) -> str:
    """CTEs of one layer with formula weights: ``out`` has vec_id and h, from ``before`` with vec_id and h."""
    value = f"list_dot_product(h, w) + b"
    return f""", {out}_w as (select j, list_transform(range({inputs}), lambda i: sin(j * {inputs} + i + {1 + phase}) / sqrt({inputs})) as w, sin(j + {1 + phase}) / 10 as b from range({outputs}) t(j)),
        {out} as (select vec_id, list({f'greatest({value}, 0.0::double)' if relu else value} order by j) as h from {before} cross join {out}_w group by vec_id)"""


def _chain(before: str, name: str, widths, inputs: int, phase: int) -> tuple[str, str]:
    """CTEs of consecutive layers, and the name of the last."""
    sql = ""
    for i, (n, m) in enumerate(zip(widths, (inputs, *widths))):
        sql += _dense(f"{name}{i}", before, n, m, phase + 10 * i)
        before = f"{name}{i}"
    return sql, before


def _tile(x: str, width: int, size: int) -> str:
    return f"list_transform(range({size}), lambda i: {x}[i % {width} + 1])"


_VECTORS = "v as (select vec_id, x_train::double[] as x from dl_train_data where len(x_train) = 32 and len(list_filter(x_train, lambda e: e is null or isnan(e))) = 0)"
_X = f"with {_VECTORS}, h as (select vec_id, x as h from v)"
_E = "with e as (select vec_id, label, embedding::double[] as x from embeddings)"
_IMAGE, _HEADS = scoring.SHARED["image"], scoring.HEADS
_ENCODED, _LAST = _chain("h", "enc", scoring.SHARED["clinical"], CLINICAL, 0)


def _classified(before: str) -> str:
    shared, last = _chain(before, "back", scoring.SHARED["backbone"], scoring.SHARED["clinical"][-1], 40)
    return shared + _dense("logit", last, 1, scoring.SHARED["backbone"][-1], 60, False)


_IMAGE_LOGIT = _E + f", h as (select vec_id, {_tile('x', WIDTH, _IMAGE[0])} as h from e)" + _dense("proj", "h", _IMAGE[1], _IMAGE[0], 30) + _classified("proj")


def _head_sql(name: str, phase: int) -> str:
    size, hidden, _ = _HEADS[name]
    return _E + f", h as (select vec_id, {_tile('x', WIDTH, size)} as h from e)" + _dense("mid", "h", hidden, size, phase) + _dense("logit", "mid", 1, hidden, phase + 10, False) + " select vec_id, round(h[1], 6) as logit from logit"


_LF = scoring.LATE_FUSION
_BRANCH, _BRANCH_LAST = _chain("h", "enc", _LF["clinical"], CLINICAL, 0)
_SOFTPLUS = "(greatest({0}, 0::double) + ln(1 + exp(-abs({0}))))"


def _bce(z: str, w: float = 1.0) -> str:
    return f"({w}::double * y * {_SOFTPLUS.format('-' + z)} + (1 - y) * {_SOFTPLUS.format(z)})"


_BATCHED = _SCORES + f", l as (select vec_id, {_bce('z')} as loss, (row_number() over (order by md5('0:' || vec_id)) - 1) // 64 as batch from known where model = 'head_a'), per as (select batch, avg(loss) as m, count(*) as n from l group by 1)"

ORACLES = {
    "threshold_sweep": _SCORES + _CURVE + _COUNTS + """select model, threshold, tn, fp, fn, tp, round(accuracy, 6) as accuracy, round(recall, 6) as recall, round("precision", 6) as "precision", round(f1, 6) as f1, round(specificity, 6) as specificity, round(roc_auc, 6) as roc_auc, round(average_precision, 6) as average_precision from rate join area using (model) where model = 'head_a'""",
    "roc_auc": _SCORES + _CURVE + "select model, round(roc_auc, 6) as roc_auc from area",
    "average_precision": _SCORES + _CURVE + "select model, round(average_precision, 6) as average_precision from area",
    "classification_report": _SCORES + _COUNTS + """,
        c as (select * from cnt where model = 'head_a' and threshold = 0.5),
        k as (
            select model, '0' as class_name, coalesce(tn / nullif(tn + fn, 0), 0) as a, coalesce(tn / nullif(tn + fp, 0), 0) as b, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) as c, tn + fp as s from c
            union all select model, '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0), tp + fn from c
        ),
        r as (
            select * from k
            union all select model, 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn from c
            union all select model, 'macro avg', avg(a), avg(b), avg(c), sum(s) from k group by model
            union all select model, 'weighted avg', sum(a * s) / sum(s), sum(b * s) / sum(s), sum(c * s) / sum(s), sum(s) from k group by model
        )
        select model, class_name, round(a, 4) as "precision", round(b, 4) as recall, round(c, 4) as f1, s::bigint as support from r""",
    "model_comparison": _SCORES + _CURVE + _COUNTS + """,
        w as (select model, threshold, unnest([struct_pack(ordinal := 0, metric := 'accuracy', score := accuracy), struct_pack(ordinal := 1, metric := 'recall', score := recall), struct_pack(ordinal := 2, metric := 'precision', score := "precision"), struct_pack(ordinal := 3, metric := 'f1', score := f1), struct_pack(ordinal := 4, metric := 'roc_auc', score := roc_auc), struct_pack(ordinal := 5, metric := 'average_precision', score := average_precision), struct_pack(ordinal := 6, metric := 'specificity', score := specificity)]) as c from rate join area using (model) where threshold = 0.5)
        select model, threshold, c.ordinal as ordinal, c.metric as metric, round(c.score, 6) as score from w""",
    "multiclass_macro": f"""
        with z as (select vec_id, label, list_transform(range({CLASSES}), lambda c: exp(list_dot_product(embedding::double[], list_transform(range({WIDTH}), lambda i: sin(i + {WIDTH} * c + 1))))) as e from embeddings),
        q as (select vec_id, label, list_transform(e, lambda x: x / list_sum(e)) as pr from z where label is not null),
        h as (select *, list_position(pr, list_max(pr)) - 1 as pred from q),
        known as (select k.c as model, (label = k.c)::int as y, pr[k.c + 1] as p, pred = k.c as hit from h cross join (select unnest(range({CLASSES})) as c) k)
        {_CURVE},
        per_class as (select model, count(*) filter (hit and y = 1) as tp, count(*) filter (hit) as said, count(*) filter (y = 1) as have, count(*) as n from known group by 1)
        select round(sum(tp) / max(n), 6) as accuracy, round(avg(coalesce(tp / nullif(said, 0), 0)), 6) as macro_precision, round(avg(coalesce(tp / nullif(have, 0), 0)), 6) as macro_recall,
            round(avg(coalesce(2 * tp / nullif(said + have, 0), 0)), 6) as macro_f1, round(avg(roc_auc), 6) as macro_roc_auc, round(avg(average_precision), 6) as macro_average_precision
        from per_class join area using (model)""",
    "linear_sigmoid_score": _SCORES + "select vec_id, round(z, 6) as z, round(p, 6) as p from s where model = 'head_a'",
    "clinical_mlp_forward": _X + _ENCODED + f" select vec_id, round(h[1], 6) as f0, round(h[2], 6) as f1, round(h[3], 6) as f2, round(h[4], 6) as f3, round(list_sum(list_transform(h, lambda z, i: z * i)), 6) as position_sum from {_LAST}",
    "uml_forward_clinical": _X + _ENCODED + _classified(_LAST) + " select vec_id, round(h[1], 6) as logit from logit",
    "uml_forward_image": _IMAGE_LOGIT + " select vec_id, round(h[1], 6) as logit from logit",
    "uml_image_evaluation": _IMAGE_LOGIT + f", known as (select 'shared_image' as model, {_Y} as y, round(1 / (1 + exp(-h[1])), 9) as p from logit join e using (vec_id) where {_Y} is not null)" + _CURVE + _COUNTS + """select model, threshold, tn, fp, fn, tp, round(accuracy, 6) as accuracy, round(recall, 6) as recall, round("precision", 6) as "precision", round(f1, 6) as f1, round(specificity, 6) as specificity, round(roc_auc, 6) as roc_auc, round(average_precision, 6) as average_precision from rate join area using (model)""",
    "resnet_head_forward": _head_sql("resnet", 200),
    "vit_head_forward": _head_sql("vit", 230),
    "late_fusion_forward": _X + _BRANCH + f""", im as (select vec_id, {_tile('x', 24, _LF["image"])} as h from v)""" + _dense("image_l", "im", 1, _LF["image"], 70, False) + _dense("clinical_l", _BRANCH_LAST, 1, _LF["clinical"][-1], 80, False)
    + f", joined as (select vec_id, list_concat(im.h, c.h) as h from im join {_BRANCH_LAST} c using (vec_id))" + _dense("fused", "joined", _LF["fusion"], _LF["image"] + _LF["clinical"][-1], 90) + _dense("fusion_l", "fused", 1, _LF["fusion"], 95, False)
    + " select vec_id, round(image_l.h[1], 6) as image_logit, round(clinical_l.h[1], 6) as clinical_logit, round(fusion_l.h[1], 6) as fusion_logit from image_l join clinical_l using (vec_id) join fusion_l using (vec_id)",
    "layernorm_meanpool": """
        with m as (select vec_id, list_transform(range(16), lambda i: (embedding[17 + i]::double + embedding[33 + i]::double + embedding[49 + i]::double) / 3) as f from embeddings),
        n as (select vec_id, f, list_avg(f) as mu, list_avg(list_transform(f, lambda x: (x - list_avg(f)) * (x - list_avg(f)))) as va from m)
        select vec_id, """ + ", ".join(f"round((f[{i + 1}] - mu) / sqrt(va + 1e-5), 5) as f{i}" for i in range(16)) + " from n",
    "bce_pos_weight": _SCORES + f"select vec_id, round({_bce('z', 2.5)}, 6) as loss from known where model = 'head_a'",
    "focal_loss": _SCORES + f"select vec_id, round(0.75::double * pow(1 - exp(-{_bce('z')}), 2) * {_bce('z')}, 6) as loss from known where model = 'head_a'",
    "composite_loss": _SCORES + f", l as (select vec_id, model, {_bce('z')} as loss from known) select vec_id, round(sum(loss), 6) as late_fusion, round(sum(loss) filter (model <> 'head_c'), 6) as shared_backbone from l group by vec_id",
    "epoch_loss_weighted": _BATCHED + " select round(sum(m * n) / sum(n), 6) as epoch_loss, count(*) as batches from per",
    "epoch_loss_batch_mean": _BATCHED + " select round(avg(m), 6) as epoch_loss, count(*) as batches from per",
    "batch_assign": "with o as (select vec_id, row_number() over (order by md5('3:' || vec_id)) - 1 as pos, count(*) over () as n from dl_train_data) select vec_id, pos // 64 as batch, pos % 64 as slot from o where pos // 64 < n // 64",
}
ORACLES["confusion_by_threshold"] = _SCORES + """
    select model, threshold, a.actual, b.predicted, count(*) filter (y = a.actual and (p > threshold)::int = b.predicted) as n
    from known cross join (select unnest([0.1, 0.2, 0.3, 0.4, 0.5]::double[]) as threshold) cross join (select unnest([0, 1]) as actual) a cross join (select unnest([0, 1]) as predicted) b
    where model = 'head_a' group by all"""
