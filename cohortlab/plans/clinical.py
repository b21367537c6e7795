"""Queries of the clinical table: profile, cleaning, encoding, splits, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators import balance, clean, describe, encode, labels, split
from cohortlab.plans.common import position_sum, read, rounded
from cohortlab.session import materialize
from cohortlab.sources import readers

NUMERIC = ("age", "ca125", "he4", "tumor_size_mm", "bmi")
PASSTHROUGH = ("family_history", "ultrasound_score")
CATEGORIES = ("menopause_status", "figo_stage")


def _records(spark, folder):
    return read(spark, folder, "ovarian_patient_data")


def describe_numeric(spark, folder):
    return rounded(describe.describe_numeric(_records(spark, folder)))


def missing_report(spark, folder):
    return rounded(describe.missing_report(_records(spark, folder)))


def schema_report(spark, folder):
    return describe.schema_report(_records(spark, folder))


def dtype_routing(spark, folder):
    return describe.dtype_routing(_records(spark, folder))


def iqr_bounds(spark, folder):
    return rounded(describe.iqr_bounds(_records(spark, folder), NUMERIC))


def boxplot_summary(spark, folder):
    return rounded(describe.boxplot_summary(_records(spark, folder), NUMERIC))


def iqr_cap(spark, folder):
    return rounded(clean.iqr_cap(_records(spark, folder).select("row_id", *NUMERIC), NUMERIC))


def sample_head(spark, folder):
    return split.sample_head(read(spark, folder, "events").select("event_id", "user_id", "event_type"), "event_id")


def sample_random(spark, folder):
    return split.sample_random(read(spark, folder, "train_augmented2_data").select("sample_id", "filename"), "sample_id", 10)


def risk_binarize(spark, folder):
    return _records(spark, folder).select("row_id", clean.risk_binarize(F.col("risklabel")).alias("risk"))


def onehot_drop_first(spark, folder):
    hot = encode.onehot_drop_first(_records(spark, folder).select("row_id", *CATEGORIES), CATEGORIES)
    return hot.select("row_id", F.array_join(F.transform("onehot", lambda x: x.cast("string")), "").alias("onehot"), F.array_join("onehot_names", ",").alias("names"))


def _split(spark, folder):
    rows = _records(spark, folder).withColumn("y", clean.risk_binarize(F.col("risklabel")))
    return split.split_stratified(rows, "row_id", "y")


def split_stratified(spark, folder):
    return _split(spark, folder).select("row_id", "y", "set")


def _capped(spark, folder):
    """Split and capped rows, written once: the scaler is fitted on them and applied to them."""
    return materialize(_cap_all(spark, folder), "capped")


def _cap_all(spark, folder):
    return clean.iqr_cap(_split(spark, folder).select("row_id", "y", "set", *NUMERIC, *PASSTHROUGH, *CATEGORIES), NUMERIC)


def standardize_train_fit(spark, folder):
    rows = _capped(spark, folder)
    scaler = encode.standardize_fit(rows.where("set = 'train'"), NUMERIC)
    return rounded(encode.standardize(rows, NUMERIC, scaler).select("row_id", "set", *NUMERIC))


def clinical_feature_vector(spark, folder):
    rows = encode.onehot_drop_first(_capped(spark, folder), CATEGORIES)
    vectors = rows.select("row_id", "y", encode.feature_vector(NUMERIC, PASSTHROUGH, "onehot").alias("x"))
    filled = vectors.select("row_id", "y", F.size("x").alias("width"), F.size(F.filter("x", lambda v: v.isNull())).cast("int").alias("missing"), F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))).alias("x"))
    return rounded(filled.select("row_id", "y", "width", "missing", position_sum("x").alias("position_sum")))


def _lists(spark, folder):
    return read(spark, folder, "train_cls")


def label_binary_map(spark, folder):
    return _lists(spark, folder).select("row_id", labels.binary_label(F.col("label")).alias("binary_label"))


def label_validity_gate(spark, folder):
    """Every list with its rows, and the rows and malignant pictures that pass the gate: all or none."""
    accepted = labels.valid_lists(_lists(spark, folder), "list_id", "label").groupBy("list_id").agg(F.count(F.lit(1)).alias("accepted_rows"), F.sum(labels.binary_label(F.col("label"))).cast("long").alias("malignant"))
    return _lists(spark, folder).groupBy("list_id").agg(F.count(F.lit(1)).alias("n_rows")).join(accepted, "list_id", "left").fillna(0, ["accepted_rows"])


def label_collapse(spark, folder):
    return labels.collapse(_lists(spark, folder), "label").select("row_id", "collapsed")


def label_dedupe_last(spark, folder):
    return labels.last_per_key(_lists(spark, folder), labels.stem(F.col("filename")), ["row_id"], ["row_id", "label"])


def label_image_lookup(spark, folder):
    lines = label_dedupe_last(spark, folder)
    images = read(spark, folder, "train_augmented2_data").where("aug_k = 0").select("sample_id", "filename", labels.stem(F.col("filename")).alias("stem"))
    return labels.label_images(lines, images, ["filename", "sample_id"]).select("row_id", "sample_id", "stem", "label")


def class_balance(spark, folder):
    return balance.class_balance(read(spark, folder, "train_augmented2_data"), "labels")


def pos_weight_variants(spark, folder):
    return rounded(balance.pos_weights(read(spark, folder, "train_augmented2_data"), "labels", read(spark, folder, "dl_train_data"), "y_train"))


def augment_expand(spark, folder):
    rows = _lists(spark, folder).select("row_id", labels.binary_label(F.col("label")).alias("y"))
    return balance.augment_expand(rows.where("y is not null"), "y")


def unpaired_cyclic_join(spark, folder):
    images = split.ordered_positions(read(spark, folder, "validation_data").select("sample_id"), split.draw(1, F.col("sample_id")), "idx")
    rows = split.ordered_positions(read(spark, folder, "dl_train_data").select("vec_id"), split.draw(1, F.col("vec_id")), "idx")
    return labels.cyclic_pairs(images, rows).select("pair", "sample_id", "vec_id")


def path_stem(spark, folder):
    return read(spark, folder, "stored_files").select("entry_id", labels.stem(F.col("file_path")).alias("stem"))


def path_depth_count(spark, folder):
    return readers.folder_counts(read(spark, folder, "stored_files"), "", "file_path", ("OTU_2d", "OTU_3d", "ResNet50_ViT_Processed_Data"))


def label_text_parse(spark, folder):
    return readers.parse_labels(read(spark, folder, "train_cls_raw"), "raw_line").select("line_id", "filename", "original_label", "binary_label", "stem")


QUERIES = {
    f.__name__: f
    for f in (
        describe_numeric, missing_report, schema_report, dtype_routing, iqr_bounds, boxplot_summary, iqr_cap, sample_head, sample_random, risk_binarize,
        onehot_drop_first, split_stratified, standardize_train_fit, clinical_feature_vector, label_binary_map, label_validity_gate,
        label_collapse, label_dedupe_last, label_image_lookup, class_balance, pos_weight_variants, augment_expand, unpaired_cyclic_join,
        path_stem, path_depth_count, label_text_parse,
    )
}

# ---- SQL --------------------------------------------------------------------

_COLUMNS = ("row_id", "record_id", "patient_id", "load_id", "site_id", "record_timestamp", "risklabel", *NUMERIC, "menopause_status", "family_history", "ultrasound_score", "figo_stage", "ingested_at")
_ALL_NUMERIC = ("row_id", "load_id", "risklabel", *NUMERIC, *PASSTHROUGH)


def _long(columns) -> str:
    return "long as (" + " union all ".join(f"select '{c}' as column_name, nullif({c}::double, 'nan'::double) as v from ovarian_patient_data" for c in columns) + "), cells as (select * from long where v is not null)"


_QUART = "quart as (select column_name, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3 from cells group by 1)"
_STEM = "lower(regexp_replace(regexp_extract({0}, '[^/]*$'), '(.)\\.[^.]*$', '\\1'))"
_BIN = "case when label = 7 then 1 when label between 0 and 6 then 0 end"


def _fence(c: str) -> str:
    return f"(select q1 - 1.5 * (q3 - q1) from quart where column_name = '{c}') as {c}_lo, (select q3 + 1.5 * (q3 - q1) from quart where column_name = '{c}') as {c}_hi"


def _cap(c: str) -> str:
    return f"case when {c} < {c}_lo then {c}_lo when {c} > {c}_hi then {c}_hi else {c} end as {c}"


_CLEAN = "clean as (select * replace (" + ", ".join(f"nullif({c}, 'nan'::double) as {c}" for c in NUMERIC) + "), coalesce((risklabel >= 2)::bigint, 0) as y from ovarian_patient_data)"
_FENCES = _QUART + ", fence as (select " + ", ".join(_fence(c) for c in NUMERIC) + ")"
_SPLIT = """
    rows_ as (select *, row_number() over (partition by y order by md5('42:' || row_id)) as rn from clean),
    per as (select y, count(*) as n, sum(count(*)) over () as total from clean group by y),
    share as (select y, n, ceil(total * 0.2) as want, ceil(total * 0.2) * n / total as exact from per),
    quota as (select y, floor(exact) + (row_number() over (order by round(exact - floor(exact), 9) desc, y) <= want - sum(floor(exact)) over ())::int as q from share),
    parts as (select r.*, case when rn <= q then 'test' else 'train' end as "set" from rows_ r join quota using (y))
"""
_CAPPED = f"with {_long(NUMERIC)}, {_FENCES}, {_CLEAN}, {_SPLIT}, capped as (select * exclude ({', '.join(f'{c}_lo, {c}_hi' for c in NUMERIC)}) replace (" + ", ".join(_cap(c) for c in NUMERIC) + ") from parts cross join fence)"


def _levels(c: str) -> str:
    return f"coalesce((select list(l order by l)[2:] from (select distinct {c} as l from ovarian_patient_data where {c} is not null)), [])"


ORACLES = {
    "describe_numeric": f"with {_long(_ALL_NUMERIC)}, {_QUART}, b as (select column_name, count(v) as n, avg(v) as mean, stddev_samp(v) as std, min(v) as low, max(v) as high from cells group by 1) select column_name, n, round(mean, 6) as mean, round(std, 6) as std, round(low, 6) as low, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(high, 6) as high from b join quart using (column_name)",
    "missing_report": "with c as (" + " union all ".join(f"select '{c}' as column_name, count(*) filter ({c} is null{' or isnan(' + c + ')' if c in NUMERIC else ''}) as missing_count, count(*) as n from ovarian_patient_data" for c in ("row_id", "record_id", "patient_id", "load_id", "site_id", "record_timestamp", "risklabel", *NUMERIC, "menopause_status", "family_history", "ultrasound_score", "figo_stage", "ingested_at")) + ") select column_name, missing_count, round(100 * missing_count / n, 6) as missing_pct from c where missing_count > 0",
    "schema_report": " union all ".join(
        f"select {i} as ordinal, '{c}' as column_name, (select case type when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' else lower(type) end from pragma_table_info('ovarian_patient_data') where name = '{c}') as kind, count(*) filter (not ({c} is null{' or isnan(' + c + ')' if c in NUMERIC else ''})) as non_null from ovarian_patient_data"
        for i, c in enumerate(_COLUMNS)
    ),
    "dtype_routing": "select (cid)::int as ordinal, name as column_name, case type when 'DOUBLE' then 'numerical' when 'VARCHAR' then 'categorical' when 'BIGINT' then 'passthrough' when 'INTEGER' then 'passthrough' else 'dropped' end as route from pragma_table_info('ovarian_patient_data')",
    "iqr_bounds": f"with {_long(NUMERIC)}, {_QUART} select column_name, round(q1, 6) as q1, round(q3, 6) as q3, round(q1 - 1.5 * (q3 - q1), 6) as low, round(q3 + 1.5 * (q3 - q1), 6) as high from quart",
    "boxplot_summary": f"with {_long(NUMERIC)}, {_QUART}, f as (select *, v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from cells join quart using (column_name)) select column_name, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(min(v), 6) as low, round(max(v), 6) as high, round(min(v) filter (inside), 6) as whisker_low, round(max(v) filter (inside), 6) as whisker_high, count(*) filter (not inside) as outliers from f group by column_name, q1, median, q3",
    "iqr_cap": f"with {_long(NUMERIC)}, {_FENCES}, {_CLEAN}, k as (select row_id, " + ", ".join(_cap(c) for c in NUMERIC) + " from clean cross join fence) select row_id, " + ", ".join(f"round({c}, 6) as {c}" for c in NUMERIC) + " from k",
    "sample_head": "select event_id, user_id, event_type from events order by event_id limit 5",
    "sample_random": "select sample_id, filename from train_augmented2_data order by md5('42:' || sample_id), sample_id limit 10",
    "risk_binarize": "select row_id, coalesce((risklabel >= 2)::bigint, 0) as risk from ovarian_patient_data",
    "onehot_drop_first": f"with l as (select {_levels('menopause_status')} as m, {_levels('figo_stage')} as f) select row_id, array_to_string(list_concat(list_transform(m, lambda x: coalesce((x = menopause_status)::int, 0)), list_transform(f, lambda x: coalesce((x = figo_stage)::int, 0))), '') as onehot, array_to_string(list_concat(list_transform(m, lambda x: 'menopause_status_' || x), list_transform(f, lambda x: 'figo_stage_' || x)), ',') as names from ovarian_patient_data cross join l",
    "split_stratified": f'with {_CLEAN}, {_SPLIT} select row_id, y, "set" from parts',
    "standardize_train_fit": _CAPPED + ", s as (select " + ", ".join(f"avg({c}) as {c}_m, coalesce(nullif(stddev_pop({c}), 0), 1) as {c}_s" for c in NUMERIC) + " from capped where \"set\" = 'train') select row_id, \"set\", " + ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) as {c}" for c in NUMERIC) + " from capped cross join s",
    "clinical_feature_vector": _CAPPED + f", l as (select {_levels('menopause_status')} as m, {_levels('figo_stage')} as f), x as (select row_id, y, list_concat([{', '.join((*NUMERIC, *(c + '::double' for c in PASSTHROUGH)))}], list_transform(m, lambda v: coalesce((v = menopause_status)::int, 0)::double), list_transform(f, lambda v: coalesce((v = figo_stage)::int, 0)::double)) as x from capped cross join l) select row_id, y, len(x)::int as width, len(list_filter(x, lambda v: v is null))::int as missing, round(list_sum(list_transform(x, lambda v, i: coalesce(v, 0) * i)), 6) as position_sum from x",
    "label_binary_map": f"select row_id, ({_BIN})::int as binary_label from train_cls",
    "label_validity_gate": f"select list_id, count(*) as n_rows, case when bool_and({_BIN} is not null) then count(*) else 0 end as accepted_rows, case when bool_and({_BIN} is not null) then sum({_BIN})::bigint end as malignant from train_cls group by list_id",
    "label_collapse": "select row_id, case when (select max(label) from train_cls) > 1 then (label = 7)::bigint else label end as collapsed from train_cls",
    "label_dedupe_last": f"select {_STEM.format('filename')} as stem, max(row_id) as row_id, arg_max(struct_pack(l := label), row_id).l as label from train_cls group by 1",
    "label_image_lookup": f"with a as (select {_STEM.format('filename')} as stem, max(row_id) as row_id, arg_max(struct_pack(l := label), row_id).l as label from train_cls group by 1) select row_id, sample_id, a.stem, label from a join (select {_STEM.format('filename')} as stem, arg_max(sample_id, (filename, sample_id)) as sample_id from train_augmented2_data where aug_k = 0 group by 1) i on i.stem = a.stem",
    "class_balance": "select count(*) filter (labels = 0) as negatives, count(*) filter (labels = 1) as positives, count(*) filter (labels is null) as missing, round(count(*) filter (labels = 1) / count(*) filter (labels = 0), 2) as ratio from train_augmented2_data",
    "pos_weight_variants": "with i as (select count(*) filter (labels = 0) as n, count(*) filter (labels = 1) as p from train_augmented2_data), c as (select count(*) filter (y_train = 0) as n, count(*) filter (y_train = 1) as p from dl_train_data) select m.model, round(m.factor * (m.a * i.n + m.b * c.n) / nullif(m.a * i.p + m.b * c.p, 0), 6) as pos_weight from i cross join c cross join (values ('resnet', 2.0::double, 1, 0), ('vit', 2.0, 1, 0), ('hybrid', 1.0, 1, 0), ('late_fusion', 2.5, 1, 0), ('shared_backbone', 3.0, 1, 1), ('boosted_trees', 1.0, 0, 1)) m(model, factor, a, b)",
    "augment_expand": f"with b as (select row_id, ({_BIN})::int as y from train_cls) select row_id, y, unnest(range(case when y = 1 then 25 else 1 end))::int as copy from b where y is not null",
    "unpaired_cyclic_join": """
        with a as (select sample_id, row_number() over (order by md5('1:' || sample_id)) - 1 as idx, count(*) over () as n from validation_data),
        b as (select vec_id, row_number() over (order by md5('1:' || vec_id)) - 1 as idx, count(*) over () as n from dl_train_data),
        p as (select unnest(range(greatest((select max(n) from a), (select max(n) from b)))) as pair)
        select pair, sample_id, vec_id from p join a on a.idx = pair % a.n join b on b.idx = cast(concat('0x', substr(md5('42:' || pair), 1, 15)) as bigint) % b.n""",
    "path_stem": f"select entry_id, {_STEM.format('file_path')} as stem from stored_files",
    "path_depth_count": "with p as (select string_split(file_path, '/') as p from stored_files) select p[1] as major, p[2] as folder, count(*) as n from p where len(p) >= 2 and p[1] in ('OTU_2d', 'OTU_3d', 'ResNet50_ViT_Processed_Data') group by grouping sets ((p[1], p[2]), (p[1]))",
    "label_text_parse": f"with t as (select line_id, regexp_split_to_array(regexp_replace(regexp_replace(raw_line, '^\\s+', ''), '\\s+$', ''), '\\s+') as p from train_cls_raw where regexp_matches(raw_line, '\\S')), u as (select line_id, p[1] as filename, case when regexp_full_match(p[2], '[+-]?[0-9]{{1,18}}') then try_cast(p[2] as bigint) end as label from t) select line_id, filename, label as original_label, ({_BIN})::int as binary_label, {_STEM.format('filename')} as stem from u",
}
