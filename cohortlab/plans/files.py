"""Queries over real files: tables are written in the original formats to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlab.operators.tensor import position_sum
from cohortlab.plans.common import read, rounded
from cohortlab.session import scratch_path
from cohortlab.sources import readers, writers

CSV_COLUMNS = ("row_id", "record_timestamp", "risklabel", "age", "menopause_status")


def csv_scan(spark, folder):
    """The clinical CSV, types inferred. An empty text is a missing one in a CSV."""
    path = scratch_path(spark, "csv")
    writers.write_csv(read(spark, folder, "ovarian_patient_data").select(*CSV_COLUMNS), path)
    rows = readers.read_csv(spark, path)
    kinds = dict(rows.dtypes)
    return rows.select(
        F.col("row_id").cast("long").alias("row_id"), F.nullif(F.col("record_timestamp").cast("string"), F.lit("")).alias("record_timestamp"), F.col("risklabel").cast("long").alias("risklabel"), F.nullif(F.col("age"), F.lit(float("nan"))).alias("age"), F.nullif("menopause_status", F.lit("")).alias("menopause_status"), F.lit(kinds["age"]).alias("age_kind")
    )


def label_list_scan(spark, folder):
    """The label list as text lines."""
    path = scratch_path(spark, "labels")
    read(spark, folder, "train_cls_raw").select("raw_line").where("raw_line is not null").write.text(path)
    return readers.read_labels(spark, path).select("filename", "original_label", "binary_label", "stem")


def npz_round_trip(spark, folder):
    """The image set as NPZ archives."""
    path = scratch_path(spark, "npz")
    images = read(spark, folder, "validation_data").where(F.size("images") == 768)
    writers.write_npz(images, path, "images", "labels")
    return rounded(readers.read_npz(spark, path).select("label", position_sum(F.col("values")).alias("position_sum")), 4)


QUERIES = {f.__name__: f for f in (csv_scan, label_list_scan, npz_round_trip)}

_BIN = "case when label = 7 then 1 when label between 0 and 6 then 0 end"
_STEM = "lower(regexp_replace(regexp_extract(filename, '[^/]*$'), '(.)\\.[^.]*$', '\\1'))"

ORACLES = {
    "label_list_scan": f"with t as (select regexp_split_to_array(regexp_replace(regexp_replace(raw_line, '^\\s+', ''), '\\s+$', ''), '\\s+') as p from train_cls_raw where regexp_matches(raw_line, '\\S')), u as (select p[1] as filename, case when regexp_full_match(p[2], '[+-]?[0-9]{{1,18}}') then try_cast(p[2] as bigint) end as label from t) select filename, label as original_label, ({_BIN})::int as binary_label, {_STEM} as stem from u",
    "csv_scan": "select row_id, nullif(record_timestamp, '') as record_timestamp, risklabel, nullif(age, 'nan'::double) as age, nullif(menopause_status, '') as menopause_status, 'double' as age_kind from ovarian_patient_data",
    "npz_round_trip": "select labels as label, round(list_sum(list_transform(images::double[], lambda v, k: v * k)), 4) as position_sum from validation_data where len(images) = 768 and labels is not null",
}
