"""Column-level data quality profile from mergeable per-load states.

Checks are declared, then compiled into one grouped aggregate over one scan:
row, null and violation counts, minimum, maximum, sum, sum of squares, a
distinct-count sketch, class counts, and the keys of violating rows. States are
worked out per load and input partition and written; the state of two sets of
rows is the merge of their states, so a new load is added to a store without
reading the old ones. Findings on rows, shifts and the profile all come from
the written states.
Metrics come from states only; rates, mean, range and distinct count are compared
with the control limits of the same site's earlier loads, and class shares with
those of the preceding load.

Defined results: a null is counted as null and breaks no check; a NaN in a
floating column is counted as null; an empty table gives an empty state table;
rows whose load is null form a load of their own without a preceding one;
repeated rows count as often as they occur. Texts are measured and shown whole,
ranges of whole numbers are exact. Distinct counts are exact up to about 1,500
values and have a standard error of 0.8 % beyond.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.session import materialize

#: A load's metric is out of control beyond this many standard deviations of at least so many earlier loads.
SIGMAS, HISTORY = 3.0, 4
#: A sketch of 2^14 registers counts up to about 1,500 values exactly.
SKETCH_K = 14
#: Half the summed share differences, in %, beyond which a load has shifted; the relative error of a distinct-count sketch beyond that.
SHIFT_PCT, SKETCH_ERROR = 25, 1.04 / 2 ** (SKETCH_K / 2)


@dataclass(frozen=True)
class Check:
    """A named predicate on rows: true where the row breaks the check."""

    finding: str
    column: str
    broken: Column


@dataclass(frozen=True)
class Classes:
    """The classes of a column whose shares are compared between loads; ``of`` gives a row's class name."""

    column: str
    names: Sequence[str]
    of: Column


@dataclass(frozen=True)
class Suite:
    checks: Sequence[Check] = field(default_factory=tuple)
    classes: Sequence[Classes] = field(default_factory=tuple)


def _null(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    column = F.col(f"`{name}`")
    return column.isNull() | F.isnan(column) if kind in ("double", "float") else column.isNull()


def states(df: DataFrame, key: str, columns: Sequence[str], suite: Suite, row_key: str | None = None) -> DataFrame:
    """A row per value of ``key``, input partition and column: the mergeable state. One scan.

    Everything is aggregated inside its input partition, so a load of any size
    sends a few rows. With ``row_key`` the keys of the rows that break a check
    come along; there are no more of them than the partition has rows.
    """
    kinds = dict(df.dtypes)
    aggregates = []
    for name in columns:
        value = F.when(~_null(df, name), F.col(f"`{name}`"))
        whole, floating = kinds[name] in ("int", "bigint", "smallint", "tinyint"), kinds[name] in ("double", "float")
        number = value.cast("double") if whole or floating else F.lit(None).cast("double")
        exact = value.cast("bigint") if whole else F.lit(None).cast("bigint")
        text = F.lit(None).cast("string") if whole or floating else value.cast("string")
        hashed = F.when(value.isNotNull(), F.xxhash64(value))  # of texts themselves the sketch would leave out the empty one
        aggregates.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(_null(df, name)).alias("n_null"),
                F.min(number).alias("low"),
                F.max(number).alias("high"),
                F.min(exact).alias("low_whole"),
                F.max(exact).alias("high_whole"),
                F.min(text).alias("first_text"),
                F.max(text).alias("last_text"),
                F.sum(number).alias("total"),
                F.sum(number * number).alias("squares"),
                F.hll_sketch_agg(hashed, F.lit(SKETCH_K)).alias("sketch"),
                _broken(suite, name, row_key).alias("broken"),
                _classes(suite, name).alias("classes"),
            )
        )
    parts = df.withColumn("_part", F.spark_partition_id()).groupBy(key, "_part")
    return parts.agg(F.array(*aggregates).alias("_states")).select(key, F.explode("_states").alias("_s")).select(key, "_s.*")


def _broken(suite: Suite, name: str, row_key: str | None) -> Column:
    checks = [(c.finding, F.coalesce(c.broken, F.lit(False))) for c in suite.checks if c.column == name]
    keys = lambda broken: F.collect_list(F.when(broken, F.col(row_key))) if row_key else F.array().cast("array<bigint>")
    kind = "array<struct<name:string,n:bigint,keys:array<bigint>>>"
    return F.array(*[F.struct(F.lit(finding).alias("name"), F.count_if(broken).alias("n"), keys(broken).alias("keys")) for finding, broken in checks]).cast(kind)


def _classes(suite: Suite, name: str) -> Column:
    counts = [(label, F.count_if(c.of == label)) for c in suite.classes if c.column == name for label in c.names]
    return F.array(*[F.struct(F.lit(label).alias("name"), count.alias("n")) for label, count in counts]).cast("array<struct<name:string,n:bigint>>")


def merge_states(state: DataFrame, key: str, suite: Suite) -> DataFrame:
    """One row per ``key`` and column: states of partitions, or of old and new rows, merged in one aggregate. Keys of rows are not kept."""

    def summed(what: str, most: int) -> Column:
        names, counts = F.first(f"{what}.name"), F.array(*[F.sum(F.get(F.col(f"{what}.n"), F.lit(i))) for i in range(most)]) if most else F.array().cast("array<bigint>")
        return F.transform(names, lambda name, i: F.struct(name.alias("name"), F.get(counts, i).alias("n"))).alias(what)

    checked = Counter(c.column for c in suite.checks)
    n_checks, n_classes = max(checked.values(), default=0), max((len(c.names) for c in suite.classes), default=0)
    return state.groupBy(key, "column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        *[F.min(name).alias(name) for name in ("low", "low_whole", "first_text")],
        *[F.max(name).alias(name) for name in ("high", "high_whole", "last_text")],
        F.sum("total").alias("total"),
        F.sum("squares").alias("squares"),
        F.hll_union_agg("sketch").alias("sketch"),
        summed("broken", n_checks),
        summed("classes", n_classes),
    )


def add_to_store(df: DataFrame, store: str, key: str, columns: Sequence[str], suite: Suite, row_key: str | None = None, batch: int | str | None = None) -> None:
    """Add the states of new rows to the store, a folder of states; rows profiled before are not read again. A ``batch`` that is added again replaces what it added before."""
    states(df, key, columns, suite, row_key).write.mode("overwrite").parquet(f"{store}/batch={uuid.uuid4().hex if batch is None else batch}")


def stored_states(spark: SparkSession, store: str, key: str, suite: Suite) -> DataFrame:
    """The merged states of everything added to the store so far."""
    return merge_states(spark.read.parquet(store).drop("batch"), key, suite)


def _prior(state: DataFrame, loads: DataFrame, key: str) -> DataFrame:
    """The state of each load beside the class counts of its preceding load."""
    named = state.join(loads.select(key, "site_id", "prior_load_id", "loaded_at"), key, "left")
    before = state.select(F.col(key).alias("prior_load_id"), "column_name", F.col("n_rows").alias("prior_rows"), F.col("classes").alias("prior_classes"))
    return named.join(before, ["prior_load_id", "column_name"], "left")


def distance_parts() -> tuple[Column, Column]:
    """Numerator and denominator of half the summed share differences, in whole numbers: no rounding at the limit."""
    apart = F.aggregate(
        F.zip_with("classes", "prior_classes", lambda a, b: F.abs(a["n"] * F.col("prior_rows") - b["n"] * F.col("n_rows"))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    return apart, 2 * F.col("n_rows") * F.col("prior_rows")


def shifted_loads(state: DataFrame, loads: DataFrame, key: str, limit_pct: int = SHIFT_PCT) -> DataFrame:
    """(key, column_name) of loads whose class shares lie further than ``limit_pct`` % from those of the preceding load."""
    apart, whole = distance_parts()
    return _prior(state, loads, key).where(F.col("prior_rows").isNotNull() & (F.size("classes") > 0)).where(apart * 100 > whole * limit_pct).select(key, "column_name")


def metrics(state: DataFrame, loads: DataFrame, key: str) -> DataFrame:
    """The profile: rates, distinct counts, range, mean, distance from the preceding load, whether that is a shift, and control-limit tests.

    A row count, a rate, a mean, an end of a range or a distinct count is out of control if
    it lies more than ``SIGMAS`` standard deviations from the mean of the same
    site's earlier loads, of which at least ``HISTORY`` must have it. The
    deviation counts as no less than the metric's own error: for row counts their root, for rates that of a
    proportion estimated from the load's rows, for means that of a mean of as
    many values with the earlier loads' variance, for distinct counts that of
    the sketch. Texts have no mean, and the ends of their range are not tested.
    ``low`` and ``high`` are the range of floating columns, ``lowest`` and
    ``highest`` that of whole numbers and texts.
    """
    apart, whole = distance_parts()
    filled = F.col("n_rows") - F.col("n_null")
    broken = F.aggregate("broken", F.lit(0).cast("bigint"), lambda total, x: total + x["n"])
    out = _prior(state, loads, key).select(
        key,
        "site_id",
        "loaded_at",
        "column_name",
        "n_rows",
        "n_null",
        (F.col("n_null") / F.col("n_rows")).alias("null_rate"),
        F.round(F.hll_sketch_estimate("sketch")).cast("bigint").alias("distinct_estimate"),
        F.when(F.col("low_whole").isNull(), F.col("low")).alias("low"),
        F.when(F.col("high_whole").isNull(), F.col("high")).alias("high"),
        F.coalesce(F.col("low_whole").cast("string"), F.col("first_text")).alias("lowest"),
        F.coalesce(F.col("high_whole").cast("string"), F.col("last_text")).alias("highest"),
        F.try_divide("total", filled).alias("mean"),
        broken.alias("n_broken"),
        (broken / F.col("n_rows")).alias("broken_rate"),
        F.when(F.col("prior_rows").isNotNull() & (F.size("classes") > 0), apart / whole).alias("prior_distance"),
        F.when(F.col("prior_rows").isNotNull() & (F.size("classes") > 0), apart * 100 > whole * SHIFT_PCT).alias("shifted"),
        F.col("low").alias("_low"),
        F.col("high").alias("_high"),
        F.when(filled > 0, F.greatest(F.lit(0.0), F.try_divide("squares", filled) - F.pow(F.try_divide("total", filled), 2))).alias("_variance"),
    )
    earlier = Window.partitionBy("site_id", "column_name").orderBy("loaded_at", key).rowsBetween(Window.unboundedPreceding, -1)
    metric = {"rows": "n_rows", "null_rate": "null_rate", "broken_rate": "broken_rate", "mean": "mean", "lowest": "_low", "highest": "_high", "distinct": "distinct_estimate"}
    for name, of in metric.items():
        mean, spread, seen = F.avg(of).over(earlier), F.stddev_samp(of).over(earlier), F.count(of).over(earlier)
        rounding = 1e-9 * F.greatest(F.abs(mean), F.lit(1.0))
        least = {
            "rows": F.sqrt(mean),
            "mean": F.greatest(rounding, F.sqrt(F.try_divide(F.avg("_variance").over(earlier), F.col("n_rows") - F.col("n_null")))),
            "lowest": rounding,
            "highest": rounding,
            "distinct": F.lit(SKETCH_ERROR) * mean,
        }.get(name, F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-4)) / F.col("n_rows")))
        out = out.withColumn(f"{name}_out", F.when(F.col("site_id").isNotNull() & (seen >= HISTORY), F.abs(F.col(of) - mean) > SIGMAS * F.greatest(spread, least)))
    return out.drop("_low", "_high", "_variance")


def violations(state: DataFrame) -> DataFrame:
    """(finding, column_name, key_id): a row per broken check and row, from states that hold the rows' keys."""
    found = state.select("column_name", F.explode("broken").alias("_b"))
    return found.select(F.col("_b.name").alias("finding"), "column_name", F.explode("_b.keys").alias("key_id"))


#: ---- the checks of the clinical records ------------------------------------

FORM = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z"
EARLIEST = "2018-01-01 00:00:00"


def clinical_suite() -> Suite:
    """Checks of ``record_timestamp`` and ``risklabel``; expects the load's ``loaded_at`` as ``_loaded_at``."""
    stamp, risk = F.col("record_timestamp"), F.col("risklabel")
    real = stamp.rlike(FORM) & (stamp >= "0001") & F.substring(stamp, 1, 10).try_cast("date").isNotNull()
    at = F.when(real, stamp.try_cast("timestamp_ntz"))
    pattern = stamp.isNotNull() & ~real
    early_or_late = F.coalesce((at < F.lit(EARLIEST).cast("timestamp_ntz")) | (at > F.col("_loaded_at")), at < F.lit(EARLIEST).cast("timestamp_ntz"), F.lit(False))
    outside = risk.isNotNull() & ~risk.between(0, 3)
    state = F.when(stamp.isNull(), "null").when(pattern | early_or_late, "violating").otherwise("valid")
    code = F.when(risk.isNull(), "null").when(risk.between(0, 3), risk.cast("string")).otherwise("other")
    return Suite(
        checks=(Check("pattern", "record_timestamp", pattern), Check("range", "record_timestamp", early_or_late), Check("range", "risklabel", outside)),
        classes=(Classes("record_timestamp", ("null", "violating", "valid"), state), Classes("risklabel", ("null", "0", "1", "2", "3", "other"), code)),
    )


#: Columns and the form of their texts, their codes, and their possible values with the limits of the bins compared between loads.
FORMS = {"record_id": r"\AR[0-9]{10}\z", "patient_id": r"\AOC-[0-9]{8}\z", "site_id": r"\AS[0-9]{2,}\z"}
CODES = {"menopause_status": ("pre", "peri", "post"), "figo_stage": ("I", "II", "III", "IV"), "family_history": ("0", "1"), "ultrasound_score": ("0", "1", "2", "3", "4", "5")}
#: Highest possible values leave out the sentinel 9999 of ca125, lowest ones -1; bins are narrow enough that another unit moves a load to others.
BINS = {
    "age": (0, 120, (30, 40, 50, 60, 70)),
    "ca125": (0, 9998, (10, 20, 35, 65, 150)),
    "he4": (0, 5000, (40, 60, 80, 110, 150)),
    "tumor_size_mm": (0, 500, (15, 30, 45, 60, 80)),
    "bmi": (10, 80, (18.5, 22, 25, 28, 32)),
}


def profile_suite(columns: Sequence[str]) -> Suite:
    """Checks and classes of all clinical columns among ``columns``, those of ``clinical_suite`` included; expects the load's ``_loaded_at`` and ``_load_site``."""
    own = clinical_suite()
    checks, classes = list(own.checks), list(own.classes)

    def valid_or_not(name: str, finding: str, broken: Column) -> None:
        checks.append(Check(finding, name, broken))
        classes.append(Classes(name, ("null", "violating", "valid"), F.when(F.col(name).isNull(), "null").when(F.coalesce(broken, F.lit(False)), "violating").otherwise("valid")))

    for name in (c for c in columns if c in FORMS):
        elsewhere = F.coalesce(F.col(name) != F.col("_load_site"), F.lit(False)) if name == "site_id" else F.lit(False)
        valid_or_not(name, "pattern", ~F.col(name).rlike(FORMS[name]) | elsewhere)
    for name in (c for c in columns if c in CODES):
        code, known = F.col(name).cast("string"), F.col(name).cast("string").isin(*CODES[name])
        checks.append(Check("domain", name, code.isNotNull() & ~known))
        classes.append(Classes(name, ("null", *CODES[name], "other"), F.when(code.isNull(), "null").when(known, code).otherwise("other")))
    for name in (c for c in columns if c in BINS):
        low, high, limits = BINS[name]
        value = F.col(name).cast("double")
        missing, outside = value.isNull() | F.isnan(value), ~value.between(low, high)
        bins = F.when(missing, "null").when(outside, "violating")
        for limit in limits:
            bins = bins.when(value < limit, f"under {limit}")
        checks.append(Check("range", name, ~missing & outside))
        classes.append(Classes(name, ("null", "violating", *[f"under {limit}" for limit in limits], "above"), bins.otherwise("above")))
    if "row_id" in columns:
        valid_or_not("row_id", "range", F.col("row_id") < 0)
    if "ingested_at" in columns:
        valid_or_not("ingested_at", "range", F.col("ingested_at").cast("timestamp_ntz") < F.coalesce("_loaded_at", F.lit(EARLIEST).cast("timestamp_ntz")))
    return Suite(checks, classes)


def with_load_time(records: DataFrame, loads: DataFrame) -> DataFrame:
    return records.join(loads.select("load_id", F.col("loaded_at").cast("timestamp_ntz").alias("_loaded_at"), F.col("site_id").alias("_load_site")), "load_id", "left")


def clinical_findings(records: DataFrame, loads: DataFrame) -> DataFrame:
    """(finding, column_name, key_id): rows that break a check, and loads whose shares have shifted."""
    suite = clinical_suite()
    parts = materialize(states(with_load_time(records, loads), "load_id", ["record_timestamp", "risklabel"], suite, "row_id"), "states")
    shifted = shifted_loads(merge_states(parts, "load_id", suite), loads, "load_id").select(F.lit("shift").alias("finding"), "column_name", F.col("load_id").alias("key_id"))
    return violations(parts).unionByName(shifted)


def clinical_profile(records: DataFrame, loads: DataFrame) -> DataFrame:
    """The profile of every column of the clinical records, per load."""
    columns = [c for c in records.columns if c != "load_id"]
    suite = profile_suite(columns)
    parts = materialize(states(with_load_time(records, loads), "load_id", columns, suite), "states")
    return metrics(merge_states(parts, "load_id", suite), loads, "load_id")
