from datetime import datetime

from pyspark.sql import functions as F

from cohortlab.operators import profiling
from cohortlab.streaming.profile import profile_stream

RECORDS = "row_id long, load_id long, record_timestamp string, risklabel long, age double"
LOADS = "load_id long, site_id string, prior_load_id long, loaded_at timestamp"


def loads(spark, *rows):
    return spark.createDataFrame([(i, "S", p, datetime(2021, 1, d)) for i, p, d in rows], LOADS)


def test_forms_and_ranges(spark):
    stamps = ["2020-02-29 00:00:00", "2021-02-29 00:00:00", "2020-01-01 24:00:00", "2020-01-01 10:00", " 2020-01-01 10:00:00", "2020-01-01 10:00:00 ", "2020-01-01 10:00:00\n", "0000-01-01 00:00:00", "２020-01-01 10:00:00", "2020-13-01 10:00:00", "2020-01-01 10:60:00", "", None, "2017-12-31 23:59:59", "2018-01-01 00:00:00", "2021-01-05 00:00:00", "2021-01-05 00:00:01"]
    rows = [(i, 1, s, 0, 1.0) for i, s in enumerate(stamps)] + [(100 + i, 1, None, r, 1.0) for i, r in enumerate((None, -1, 0, 3, 4))] + [(200, 9, "2030-01-01 00:00:00", 1, 1.0), (201, None, "2016-01-01 00:00:00", 1, 1.0)]
    found = profiling.clinical_findings(spark.createDataFrame(rows, RECORDS), loads(spark, (1, None, 5)))
    got = {(r.finding, r.column_name, r.key_id) for r in found.collect()}
    assert {k for f, _, k in got if f == "pattern"} == set(range(1, 12))
    assert {k for f, c, k in got if f == "range" and c == "record_timestamp"} == {13, 16, 201}
    assert {k for f, c, k in got if c == "risklabel"} == {101, 104}
    assert not [k for f, _, k in got if f == "shift"]


def test_shift_limit_is_exact(spark):
    # four rows each: one of four differs = 0.25, two differ = 0.5
    good, bad = "2020-06-01 00:00:00", "x"
    rows = [(i, 1, good, 0, 1.0) for i in range(4)] + [(10 + i, 2, good if i else bad, 0, 1.0) for i in range(4)] + [(20 + i, 3, good if i > 2 else bad, 1, 1.0) for i in range(4)]
    found = profiling.clinical_findings(spark.createDataFrame(rows, RECORDS), loads(spark, (1, None, 5), (2, 1, 6), (3, 2, 7), (4, 3, 8)))
    assert {(r.column_name, r.key_id) for r in found.where("finding = 'shift'").collect()} == {("record_timestamp", 3), ("risklabel", 3)}


def test_states_merge_to_the_same(spark):
    rows = [(i, i % 3, f"2020-01-0{1 + i % 5} 00:00:00", i % 6 if i % 4 else None, float("nan") if i % 7 == 0 else float(i)) for i in range(200)]
    table = profiling.with_load_time(spark.createDataFrame(rows, RECORDS), loads(spark, (0, None, 5), (1, None, 6), (2, None, 7)))
    suite = profiling.clinical_suite()
    columns = ["record_timestamp", "risklabel", "age"]
    part = lambda df: profiling.states(df, "load_id", columns, suite)
    whole = profiling.merge_states(part(table.coalesce(1)), "load_id", suite)
    halves = [part(table.where(F.col("row_id") % 2 == k)) for k in (0, 1)]
    merged = profiling.merge_states(halves[0].unionByName(halves[1]), "load_id", suite)
    for name in ("n_rows", "n_null", "low", "high", "low_whole", "high_whole", "first_text", "last_text", "total", "squares"):
        key = lambda df: sorted((r.load_id, r.column_name, getattr(r, name)) for r in df.collect() if getattr(r, name) is not None)  # noqa: B023, E731
        assert key(whole) == key(merged)
    classes = lambda df: {(r.load_id, r.column_name): {c.name: c.n for c in r.classes} for r in df.collect()}
    broken = lambda df: {(r.load_id, r.column_name): {c.name: c.n for c in r.broken} for r in df.collect()}
    assert classes(whole) == classes(merged) and broken(whole) == broken(merged)
    distinct = lambda df: {(r.load_id, r.column_name): r.e for r in df.select("load_id", "column_name", F.round(F.hll_sketch_estimate("sketch")).alias("e")).collect()}
    assert distinct(whole) == distinct(merged)


def test_profile_values_and_control_limits(spark):
    rows = [(100 * load + i, load, "2020-01-01 00:00:00", 0, None if (i < 2 or (load == 7 and i < 60)) else float(i)) for load in range(8) for i in range(100)]
    chain = [(i, i - 1 if i else None, 1 + i) for i in range(8)]
    out = {r.load_id: r for r in profiling.clinical_profile(spark.createDataFrame(rows, RECORDS), loads(spark, *chain)).where("column_name = 'age'").collect()}
    assert out[3].null_rate == 0.02 and out[3].low == 2.0 and out[3].high == 99.0 and out[3].distinct_estimate == 98
    assert out[7].null_rate_out is True and out[6].null_rate_out is False and out[2].null_rate_out is None


def test_every_column_is_checked_and_compared(spark):
    schema = RECORDS + ", record_id string, site_id string, ca125 double, he4 double, menopause_status string, figo_stage string, ultrasound_score long, ingested_at timestamp"
    rows = []
    for load in range(8):
        for i in range(100):
            bad, last = load == 7 and i < 60, load == 7
            ca125 = 9999.0 if last and i == 99 else 30.0 + i % 20 + load % 2
            rows.append(
                (100 * load + i, load, "2020-01-01 00:00:00", 0, 999.0 if last and i == 98 else 40.0 + i % 30, "R1" if last and i < 3 else f"R{100 * load + i:010d}", "T" if last and i < 2 else "S01", ca125)
                + ((60.0 + i % 9) / (1000 if bad else 1), "Post " if bad else "post", "iii" if last and i < 5 else None, i % 6, datetime(2020, 1, 1) if last and i < 4 else datetime(2021, 1, 20))
            )
    chain = spark.createDataFrame([(i, "S01", i - 1 if i else None, datetime(2021, 1, 1 + i)) for i in range(8)], LOADS)
    profile = profiling.clinical_profile(spark.createDataFrame(rows, schema), chain)
    out = {r.column_name: r for r in profile.where("load_id = 7").collect()}
    assert {c: out[c].n_broken for c in out if out[c].n_broken} == {"age": 1, "record_id": 3, "site_id": 2, "ca125": 1, "menopause_status": 60, "figo_stage": 5, "ingested_at": 4}
    assert "row_id" in out and all(r.prior_distance is not None for r in out.values())
    assert {c for c in out if out[c].shifted} == {"menopause_status", "he4"}
    assert out["he4"].mean_out and out["he4"].lowest_out and not out["he4"].highest_out
    assert out["ca125"].highest_out and out["ca125"].mean_out and out["age"].highest_out and out["menopause_status"].distinct_out
    assert not out["ultrasound_score"].mean_out and not out["ultrasound_score"].distinct_out and not out["ultrasound_score"].shifted
    before = {r.column_name: r for r in profile.where("load_id = 6").collect()}
    assert not any(before[c].n_broken or before[c].shifted or before[c].highest_out or before[c].distinct_out for c in before if c != "row_id")


def test_a_load_is_added_without_reading_the_old_ones(spark, tmp_path):
    rows = [(i, i % 3, f"2020-01-0{1 + i % 5} 00:00:00", i % 6, float(i)) for i in range(90)]
    chain = loads(spark, (0, None, 5), (1, 0, 6), (2, 1, 7))
    table, suite, columns, store = profiling.with_load_time(spark.createDataFrame(rows, RECORDS), chain), profiling.clinical_suite(), ["record_timestamp", "risklabel"], str(tmp_path / "store")
    for load in range(3):
        table.where(F.col("load_id") == load).drop("_loaded_at", "_load_site").write.parquet(str(tmp_path / f"load{load}"))
        fresh = profiling.with_load_time(spark.read.parquet(str(tmp_path / f"load{load}")), chain)
        profiling.add_to_store(fresh, store, "load_id", columns, suite, "row_id")
        for path in (tmp_path / f"load{load}").iterdir():
            path.unlink()  # what was profiled may be gone
    whole = profiling.merge_states(profiling.states(table, "load_id", columns, suite), "load_id", suite)
    shown = lambda state: sorted(map(str, profiling.metrics(state, chain, "load_id").collect()))
    assert shown(profiling.stored_states(spark, store, "load_id", suite)) == shown(whole)
    assert {r.key_id for r in profiling.violations(spark.read.parquet(store)).where("column_name = 'risklabel'").collect()} == {i for i in range(90) if i % 6 > 3}


def test_a_stream_adds_its_states(spark, tmp_path):
    rows = [(i, i % 3, f"2020-01-0{1 + i % 5} 00:00:00", i % 6, float(i)) for i in range(90)]
    chain = loads(spark, (0, None, 5), (1, 0, 6), (2, 1, 7))
    table, suite, columns, store = spark.createDataFrame(rows, RECORDS), profiling.clinical_suite(), ["record_timestamp", "risklabel"], str(tmp_path / "store")
    for k in range(3):
        table.where(F.col("row_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = profiling.with_load_time(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), chain)
    query = profile_stream(stream, store, "load_id", columns, suite, "row_id").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    whole = profiling.merge_states(profiling.states(profiling.with_load_time(table, chain), "load_id", columns, suite), "load_id", suite)
    shown = lambda state: sorted(map(str, profiling.metrics(state, chain, "load_id").collect()))
    assert shown(profiling.stored_states(spark, store, "load_id", suite)) == shown(whole)
    one = profiling.with_load_time(table.where("row_id % 3 = 0"), chain)
    for _ in range(2):
        profiling.add_to_store(one, str(tmp_path / "twice"), "load_id", columns, suite, batch="a")
    assert profiling.stored_states(spark, str(tmp_path / "twice"), "load_id", suite).agg(F.max("n_rows")).first()[0] == 30


def test_long_texts_and_whole_numbers_are_exact(spark):
    df = spark.createDataFrame([(1, "a" * 70 + "x", 2**60 + 1), (1, "a" * 70 + "b", 2**60 + 3)], "load_id long, t string, n long")
    suite = profiling.Suite()
    out = {r.column_name: r for r in profiling.metrics(profiling.merge_states(profiling.states(df, "load_id", ["t", "n"], suite), "load_id", suite), loads(spark, (1, None, 5)), "load_id").collect()}
    assert (out["t"].lowest, out["t"].highest) == ("a" * 70 + "b", "a" * 70 + "x")
    assert (out["n"].lowest, out["n"].highest) == (str(2**60 + 1), str(2**60 + 3))


def test_empty(spark):
    empty = spark.createDataFrame([], RECORDS)
    assert profiling.clinical_findings(empty, loads(spark, (1, None, 5))).count() == 0
    assert profiling.clinical_profile(empty, loads(spark, (1, None, 5))).count() == 0
