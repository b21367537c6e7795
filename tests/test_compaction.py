from datetime import datetime

import pytest

from cohortlab.operators import compaction
from cohortlab.session import scratch_path

LOG = "entry_id long, file_id long, folder string, file_path string, size_bytes long, n_records long, op string, modified_at timestamp"


def log(spark, *rows):
    return spark.createDataFrame([(e, f, d, f"{d}/{f}", s, n, op, datetime(2024, 1, day)) for e, f, d, s, n, op, day in rows], LOG)


ENTRIES = [
    (1, 1, "a/x=1", 10, 1, "put", 1), (2, 2, "a/x=1", 10, 2, "put", 1), (3, 3, "a/x=1", 10, 0, "put", 1),  # 3 is empty
    (4, 4, "b", 10, 1, "put", 1),  # alone in its folder
    (5, 5, "c", 2**24, 1, "put", 1), (6, 6, "c", 2**24 - 1, 1, "put", 1), (7, 7, "c", 5, 1, "put", 1),  # 5 is large
    (8, 7, "c", None, None, "delete", 2), (9, 7, "c", 5, 1, "put", 2),  # written again at the same time: the later entry counts
    (11, 8, "d", 5, 1, "put", 3), (10, 8, "d", None, None, "delete", 4), (12, 9, "d", 5, 1, "put", 1),  # 8 is deleted
]


def test_plan(spark):
    assert sorted(r.file_id for r in compaction.plan_merge(log(spark, *ENTRIES)).collect()) == [1, 2, 6, 7]


def test_rewrite_keeps_every_record_once(spark):
    records = spark.createDataFrame([(i, f, float(i) if i % 3 else None, [0.5, float(i)], "f") for i, f in enumerate([1, 2, 2, 2, 4, 5, 6, 6, None, 99] * 3)], "row_id long, file_id long, v double, a array<float>, folder string")
    target = scratch_path(spark, "compacted")
    manifest = compaction.compact(records, compaction.plan_merge(log(spark, *ENTRIES)), target)
    assert {(r.file_id, r.folder, r.n_rows) for r in manifest.collect()} == {(1, "a/x=1", 3), (2, "a/x=1", 9), (6, "c", 6), (7, "c", 0)}
    written = compaction.committed(spark, target)
    want = sorted((r.row_id, r.file_id, r.v, tuple(r.a)) for r in records.where("file_id in (1, 2, 6, 7)").collect())
    assert sorted((r.row_id, r.file_id, r.v, tuple(r.a)) for r in written.collect()) == want
    assert len(written.inputFiles()) <= 2


def test_checksum_sees_changes_and_repeats(spark):
    base = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 2, "b")], "folder string, i long, s string")
    one = lambda df: [tuple(r) for r in compaction.checksums(df, ("folder",)).collect()]
    assert one(base) == one(base.repartition(3).orderBy("s"))
    assert one(base) != one(base.distinct())
    assert one(base) != one(spark.createDataFrame([("f", 1, "b"), ("f", 2, "a"), ("f", 2, "b")], "folder string, i long, s string"))


def test_mismatch_commits_nothing(spark, monkeypatch):
    records = spark.createDataFrame([(1, 1), (2, 2)], "row_id long, file_id long")
    target = scratch_path(spark, "compacted")
    real = compaction.checksums
    calls = []

    def crooked(df):
        calls.append(1)
        return real(df if len(calls) == 1 else df.limit(1))

    monkeypatch.setattr(compaction, "checksums", crooked)
    with pytest.raises(RuntimeError):
        compaction.compact(records, compaction.plan_merge(log(spark, *ENTRIES)), target)
    assert compaction.current_version(spark, target) is None


def test_log_retires_what_was_rewritten(spark):
    records = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 6)], "row_id long, file_id long")
    target = scratch_path(spark, "compacted")
    compaction.compact(records, compaction.plan_merge(log(spark, *ENTRIES)), target)
    entries = compaction.committed(spark, target, "log").collect()
    assert {(r.file_id, r.file_path) for r in entries if r.op == "delete"} == {(1, "a/x=1/1"), (2, "a/x=1/2"), (6, "c/6")}  # 7 has no record here
    new = [r for r in entries if r.op == "put"]
    assert {r.folder: r.n_records for r in new} == {"a/x=1": 3, "c": 1} and all(r.size_bytes > 0 for r in new)


def test_a_crash_before_the_commit_keeps_the_old_version(spark, monkeypatch):
    records = spark.createDataFrame([(1, 1), (2, 2)], "row_id long, file_id long")
    plan, target = compaction.plan_merge(log(spark, *ENTRIES)), scratch_path(spark, "compacted")
    compaction.compact(records, plan, target)
    real = compaction._replace_pointer

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(compaction, "_replace_pointer", crash)
    with pytest.raises(OSError):
        compaction.compact(records.where("row_id = 1"), plan, target)
    assert sorted(r.row_id for r in compaction.committed(spark, target).collect()) == [1, 2]
    monkeypatch.setattr(compaction, "_replace_pointer", real)
    compaction.compact(records.where("row_id = 2"), plan, target)
    assert [r.row_id for r in compaction.committed(spark, target).collect()] == [2]
    fs, at = compaction.hadoop_fs(spark, target)
    assert len([s for s in fs.listStatus(at) if s.isDirectory()]) == 1


def test_empty(spark):
    records = spark.createDataFrame([], "row_id long, file_id long")
    out = compaction.compact_store(log(spark), {"t": records})
    assert compaction.merged_files(spark, out).count() == 0 and compaction.committed(spark, out["t"], "log").count() == 0
