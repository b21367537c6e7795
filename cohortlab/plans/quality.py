"""Queries of the general training-data problems: profile, failing lines, small files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import compaction, line_parsing, profiling
from cohortlab.plans.common import rounded


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.clinical_findings(_read(spark, folder, "ovarian_patient_data"), _read(spark, folder, "clinical_loads"))


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profiling.clinical_profile(_read(spark, folder, "ovarian_patient_data"), _read(spark, folder, "clinical_loads")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return line_parsing.parse_label_lines(_read(spark, folder, "train_cls_raw"))[1].select("line_id", "reason")


def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    return line_parsing.parse_label_lines(_read(spark, folder, "train_cls_raw"))[0].select("line_id", "delivery_id", "line_no", "filename", "label")


def _compacted(spark: SparkSession, folder: str) -> dict[str, str]:
    tables = {name: _read(spark, folder, name) for name in ("train_cls", "train_augmented2_data")}
    return compaction.compact_store(_read(spark, folder, "stored_files"), tables)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The merged files: those of the plan whose every logged record was rewritten and committed."""
    return compaction.merged_files(spark, _compacted(spark, folder)).where("complete").select("file_id")


def p5_folders(spark: SparkSession, folder: str) -> DataFrame:
    merged = compaction.merged_files(spark, _compacted(spark, folder))
    return merged.groupBy("folder").agg(
        F.count(F.lit(1)).alias("files_merged"), F.sum("size_bytes").alias("bytes_before"), F.sum("n_records").alias("records_logged"), F.sum("n_rows").alias("records_rewritten"), F.count_if("complete").alias("files_retired")
    )


def p5_files(spark: SparkSession, folder: str) -> DataFrame:
    """The well-sized files that took the small ones' place, from the committed logs."""
    logs = [compaction.committed(spark, target, "log").withColumn("table_name", F.lit(name)) for name, target in _compacted(spark, folder).items()]
    new = reduce(DataFrame.unionByName, logs).where("op = 'put'")
    return new.groupBy("table_name", "folder").agg(F.count(F.lit(1)).alias("files_after"), F.sum("n_records").alias("records"), F.sum("size_bytes").alias("bytes_after"), F.max("size_bytes").alias("largest"))


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p4_found, p4_rows, p5_found, p5_folders, p5_files)}

_FIELD = '(?:"[^"]*(?:""[^"]*)*"|[^ \\t"]+)'
_LINES = f"""
    with trimmed as (select line_id, delivery_id, line_no, regexp_replace(regexp_replace(raw_line, '^[ \\t\\r]+', ''), '[ \\t\\r]+$', '') as line from train_cls_raw),
    parsed as (
        select *, regexp_full_match(line, '{_FIELD}(?:[ \\t]+{_FIELD})*') as quoted_well, regexp_extract_all(line, '{_FIELD}') as found
        from trimmed where line <> ''
    ),
    fields as (
        select *, list_transform(found, lambda f: case when f[1] = '"' then replace(f[2:-2], '""', '"') else f end) as f from parsed
    ),
    judged as (
        select *, case when not quoted_well then 'quoting'
            when len(f) <> 2 then 'column_count'
            when not regexp_full_match(f[1], '(?s)[^/\\\\]+\\.(?i:jpg|jpeg|png)') or not regexp_full_match(f[2], '[0-7]') then 'invalid_value' end as reason
        from fields
    )
"""

_REAL = "coalesce(regexp_full_match(record_timestamp, '[0-9]{4}-[0-9]{2}-[0-9]{2} (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') and record_timestamp >= '0001' and try_cast(substr(record_timestamp, 1, 10) as date) is not null, false)"



def _profile_cells() -> str:
    """SQL of a row per record and column: is it missing, its number, whole number or text, does it break a check, its class."""
    three = "case when {0} is null then 'null' when {1} then 'violating' else 'valid' end"
    bad_time = f"({_REAL} and (try_cast(record_timestamp as timestamp) < timestamp '2018-01-01' or coalesce(try_cast(record_timestamp as timestamp) > loaded_at, false)))"
    bad_stamp = f"coalesce(record_timestamp is not null and (not {_REAL} or {bad_time}), false)"
    columns = {
        "record_timestamp": ("text", bad_stamp, three.format("record_timestamp", bad_stamp)),
        "risklabel": ("whole", "coalesce(risklabel not between 0 and 3, false)", "case when risklabel is null then 'null' when risklabel between 0 and 3 then risklabel::varchar else 'other' end"),
        "row_id": ("whole", "coalesce(row_id < 0, false)", three.format("row_id", "row_id < 0")),
        "ingested_at": ("text", "coalesce(ingested_at < coalesce(loaded_at, timestamp '2018-01-01'), false)", three.format("ingested_at", "ingested_at < coalesce(loaded_at, timestamp '2018-01-01')")),
    }
    for name, form in profiling.FORMS.items():
        bad = f"coalesce(not regexp_full_match({name}, '{form[2:-2]}'), false)"
        bad = f"({bad} or coalesce(site_id <> load_site, false))" if name == "site_id" else bad
        columns[name] = ("text", bad, three.format(name, bad))
    for name, codes in profiling.CODES.items():
        known = f"{name}::varchar in ({', '.join(repr(c) for c in codes)})"
        columns[name] = ("whole" if name in ("family_history", "ultrasound_score") else "text", f"coalesce(not ({known}), false)", f"case when {name} is null then 'null' when {known} then {name}::varchar else 'other' end")
    for name, (low, high, limits) in profiling.BINS.items():
        missing, outside = f"({name} is null or isnan({name}))", f"{name} not between {low} and {high}"
        bins = " ".join(f"when {name} < {limit} then 'under {limit}'" for limit in limits)
        columns[name] = ("number", f"(not {missing} and {outside})", f"case when {missing} then 'null' when {outside} then 'violating' {bins} else 'above' end")
    cells = []
    for name, (kind, bad, label) in columns.items():
        missing = f"({name} is null or isnan({name}))" if kind == "number" else f"{name} is null"
        value = lambda k, as_: f"case when not {missing} then {name} end::{as_}" if kind in k else f"null::{as_}"  # noqa: B023, E731
        cells.append(f"select load_id, '{name}' as column_name, ({missing}) as missing, {value(('number',), 'double')} as num, {value(('whole',), 'bigint')} as whole, {value(('text',), 'varchar')} as text, ({bad})::int as bad, {label} as class from r")
    return " union all ".join(cells)


def _limits() -> str:
    """SQL of the control-limit columns over the window ``w`` of a site's earlier loads."""
    floor = {
        "rows": "sqrt(avg(n_rows) over w)",
        "mean": "greatest(1e-9 * greatest(abs(avg(mean) over w), 1), coalesce(sqrt((avg(variance) over w) / nullif(n_rows - n_null, 0)), 0))",
        "lowest": "1e-9 * greatest(abs(avg(low_all) over w), 1)",
        "highest": "1e-9 * greatest(abs(avg(high_all) over w), 1)",
        "distinct": "1.04 / 128 * avg(distinct_estimate) over w",
    }
    of = {"rows": "n_rows", "null_rate": "null_rate", "broken_rate": "broken_rate", "mean": "mean", "lowest": "low_all", "highest": "high_all", "distinct": "distinct_estimate"}
    out = []
    for name, column in of.items():
        mean = f"avg({column}) over w"
        least = floor.get(name, f"sqrt(greatest({mean} * (1 - {mean}), 1e-4) / n_rows)")
        out.append(f"case when site_id is not null and count({column}) over w >= 4 then abs({column} - {mean}) > 3 * greatest(stddev_samp({column}) over w, {least}) end as {name}_out")
    return ", ".join(out)


_CHOSEN = """
    with state as (
        select file_id, arg_max(struct_pack(folder := folder, op := op, n := n_records, size := size_bytes), (modified_at, entry_id)) as s
        from stored_files group by file_id
    ),
    live as (select file_id, s.folder as folder, s.size as size_bytes, s.n as n_records from state where s.op = 'put' and s.n > 0 and s.size < 16777216),
    chosen as (select * from live where folder in (select folder from live group by folder having count(*) >= 2))
"""

ORACLES = {
    "p2_found": f"""
        with r as (
            select d.*, l.loaded_at, {_REAL} as real_time,
                case when {_REAL} then try_cast(record_timestamp as timestamp) end as stamped
            from ovarian_patient_data d left join clinical_loads l using (load_id)
        ),
        c as (
            select *, record_timestamp is not null and not real_time as bad_form,
                coalesce(stamped < timestamp '2018-01-01' or stamped > loaded_at, false) as bad_time,
                coalesce(risklabel not between 0 and 3, false) as bad_risk
            from r
        ),
        share as (
            select load_id, 'record_timestamp' as column_name, case when record_timestamp is null then 'null' when bad_form or bad_time then 'violating' else 'valid' end as class, count(*) as n from c group by all
            union all
            select load_id, 'risklabel', case when risklabel is null then 'null' when bad_risk then 'other' else risklabel::varchar end, count(*) from c group by all
        ),
        total as (select load_id, count(*) as n from c group by 1),
        pair as (
            select l.load_id, l.prior_load_id, k.column_name, k.class, a.n as n1, b.n as n0
            from clinical_loads l join total a on a.load_id = l.load_id join total b on b.load_id = l.prior_load_id
            cross join (select distinct column_name, class from share) k
        ),
        apart as (
            select p.load_id, p.column_name, sum(abs(coalesce(x.n, 0) * p.n0 - coalesce(y.n, 0) * p.n1)) as d, any_value(p.n0 * p.n1) as whole
            from pair p
            left join share x on x.load_id = p.load_id and x.column_name = p.column_name and x.class = p.class
            left join share y on y.load_id = p.prior_load_id and y.column_name = p.column_name and y.class = p.class
            group by all
        )
        select 'pattern' as finding, 'record_timestamp' as column_name, row_id as key_id from c where bad_form
        union all select 'range', 'record_timestamp', row_id from c where bad_time
        union all select 'range', 'risklabel', row_id from c where bad_risk
        union all select 'shift', column_name, load_id from apart where 2 * d > whole
    """,
    "p2_profile": f"""
        with r as (select d.*, l.loaded_at, l.site_id as load_site from ovarian_patient_data d left join clinical_loads l using (load_id)),
        cell as ({_profile_cells()}),
        state as (
            select load_id, column_name, count(*) as n_rows, count(*) filter (missing) as n_null, count(distinct coalesce(num::varchar, whole::varchar, text)) as distinct_estimate,
                min(num) as low, max(num) as high, coalesce(min(whole)::varchar, min(text)) as lowest, coalesce(max(whole)::varchar, max(text)) as highest,
                min(coalesce(num, whole)) as low_all, max(coalesce(num, whole)) as high_all, avg(coalesce(num, whole)) as mean,
                greatest(0, avg(coalesce(num, whole) ** 2) - avg(coalesce(num, whole)) ** 2) as variance, sum(bad)::bigint as n_broken
            from cell group by all
        ),
        share as (select load_id, column_name, class, count(*) as n from cell group by all),
        pair as (
            select l.load_id, l.prior_load_id, k.column_name, k.class, a.n_rows as n1, b.n_rows as n0
            from clinical_loads l join (select distinct column_name, class from share) k on true
            join state a on a.load_id = l.load_id and a.column_name = k.column_name join state b on b.load_id = l.prior_load_id and b.column_name = k.column_name
        ),
        apart as (
            select p.load_id, p.column_name, sum(abs(coalesce(x.n, 0) * p.n0 - coalesce(y.n, 0) * p.n1)) as d, any_value(2 * p.n0 * p.n1) as whole
            from pair p
            left join share x on x.load_id = p.load_id and x.column_name = p.column_name and x.class = p.class
            left join share y on y.load_id = p.prior_load_id and y.column_name = p.column_name and y.class = p.class
            group by all
        ),
        m as (
            select s.*, l.site_id, l.loaded_at, n_null / n_rows as null_rate, n_broken / n_rows as broken_rate, d / whole as prior_distance, d * 100 > whole * 25 as shifted
            from state s left join clinical_loads l using (load_id) left join apart using (load_id, column_name)
        )
        select load_id, site_id, loaded_at, column_name, n_rows, n_null, round(null_rate, 6) as null_rate, distinct_estimate, round(low, 6) as low, round(high, 6) as high, lowest, highest,
            round(mean, 6) as mean, n_broken, round(broken_rate, 6) as broken_rate, round(prior_distance, 6) as prior_distance, shifted, {_limits()}
        from m window w as (partition by site_id, column_name order by loaded_at, load_id rows between unbounded preceding and 1 preceding)
    """,
    "p4_found": _LINES + "select line_id, reason from judged where reason is not null",
    "p4_rows": _LINES + "select line_id, delivery_id, line_no, f[1] as filename, f[2]::bigint as label from judged where reason is null",
    "p5_found": _CHOSEN + "select file_id from chosen",
    "p5_folders": _CHOSEN + """,
        rec as (select file_id, count(*) as n from (select file_id from train_cls union all select file_id from train_augmented2_data) group by 1)
        select folder, count(*) as files_merged, sum(size_bytes)::bigint as bytes_before, sum(n_records)::bigint as records_logged, sum(coalesce(n, 0))::bigint as records_rewritten, count(*) filter (coalesce(n, 0) = n_records) as files_retired
        from chosen left join rec using (file_id) group by folder
    """,
}
