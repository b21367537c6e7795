"""Rewrite many small files into few well-sized ones, each record exactly once.

Plan: a file's state is its latest log entry; folders with at least two small
live files are merged. Rewrite: the records of those files are shuffled under an
adaptive REBALANCE hint, so that runtime statistics merge or split the output
partitions near the target size (of shuffled bytes; Parquet files come out
smaller). Commit: the output is a version of its own below the target. After its
multiset checksums (count, sum and xor of two row hashes, per folder and source
file) equal those of the source, a small pointer file is replaced in one step to
name it, and only then are older versions removed. Readers follow the pointer,
so a crash at any point leaves the last committed version readable; versions
without a pointer are removed by the next commit. The log entries that retire
the small files and announce the new ones are part of the version.

Defined results: records without a file, or of a file that is not merged, stay
where they are; a merged file without records is listed with 0 rows; a file
whose rewritten rows are not as many as logged is not retired; repeated
records are kept as often as they occur; an empty plan or table commits an empty
output. Column names of the records are kept; the folder comes as ``folder``
from the log (a record column of that name is replaced).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators.joins import checked_join
from cohortlab.session import delete_path, hadoop_fs, materialize, scratch_path

#: A file below this is small; output files aim at this size.
SMALL_BYTES = 16 * 1024 * 1024
TARGET_BYTES = 128 * 1024 * 1024
#: File systems where writing one file is atomic and renaming is not.
ATOMIC_WRITES = ("s3a", "gs", "abfs", "abfss", "oss")


def file_states(log: DataFrame) -> DataFrame:
    """The latest entry of each file: greatest ``modified_at``, then greatest ``entry_id``."""
    entry = F.struct("folder", "file_path", "size_bytes", "n_records", "op")
    return log.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max_by(entry, F.struct("modified_at", "entry_id")).alias("_s")).select("file_id", "_s.*")


def plan_merge(log: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(file_id, folder, file_path, size_bytes, n_records) of the files to merge. Counting per folder is pre-aggregated, so one huge folder is no hot task."""
    live = file_states(log).where((F.col("op") == "put") & (F.col("n_records") > 0) & (F.col("size_bytes") < small_bytes) & F.col("folder").isNotNull())
    many = live.groupBy("folder").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("folder")
    return live.join(many, "folder", "left_semi").select("file_id", "folder", "file_path", "size_bytes", "n_records")


def _checksum(df: DataFrame) -> list[Column]:
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(one.cast("decimal(20,0)")).cast("string").alias("hash_sum"),
        F.bit_xor(two).alias("hash_xor"),
    ]


def checksums(df: DataFrame, by: tuple[str, ...] = ("folder", "file_id")) -> DataFrame:
    """The multiset checksum per folder and source file; any order and any split into output files gives the same."""
    return df.groupBy(*by).agg(*_checksum(df))


def _replace_pointer(spark: SparkSession, target: str, version: str) -> None:
    """Make ``version`` the current one: the pointer file is written aside and renamed over the old one, or written at once where a write is atomic and a rename is not."""
    jvm = spark.sparkContext._jvm
    fs, at = hadoop_fs(spark, f"{target}/CURRENT")
    aside = at if fs.getScheme() in ATOMIC_WRITES else hadoop_fs(spark, f"{target}/CURRENT.{version}")[1]
    out = fs.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    if aside is not at:
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, at, options)


def current_version(spark: SparkSession, target: str) -> str | None:
    """The folder of the committed version, None if there is none."""
    fs, at = hadoop_fs(spark, f"{target}/CURRENT")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    version = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return f"{target}/{version}"


def committed(spark: SparkSession, target: str, part: str = "data") -> DataFrame:
    """``data``, ``manifest`` (file_id, folder, size_bytes, n_records, n_rows) or ``log`` (folder, file_path, size_bytes, n_records, op, file_id) of the committed version."""
    return spark.read.parquet(f"{current_version(spark, target)}/{part}")


def _remove_others(spark: SparkSession, target: str, version: str) -> None:
    fs, at = hadoop_fs(spark, target)
    for status in fs.listStatus(at):  # a few versions
        if status.getPath().getName() not in (version, "CURRENT"):
            fs.delete(status.getPath(), True)


def compact(records: DataFrame, merge: DataFrame, target: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Rewrite the records of the files in ``merge`` as a new version of ``target``; returns the committed manifest, a row per merged file.

    Raises RuntimeError, leaving the committed version as it was, if the checksums differ.
    """
    spark = records.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    at = f"{target}/{version}"
    chosen = checked_join(records.drop("folder"), merge.select("file_id", "folder"), "file_id")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    try:
        chosen.hint("rebalance", "folder").write.mode("overwrite").partitionBy("folder").parquet(f"{at}/data")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    schema = chosen.select(*[c for c in chosen.columns if c != "folder"], F.col("folder").cast("string")).schema
    stored = spark.read.schema(schema).parquet(f"{at}/data")
    source, result = checksums(chosen), materialize(checksums(stored.select(*chosen.columns)), "checksums")
    pairs = source.withColumnsRenamed({c: f"s_{c}" for c in source.columns}).join(result, (F.col("s_folder") == F.col("folder")) & (F.col("s_file_id") == F.col("file_id")), "full")
    same = F.lit(True)
    for name in source.columns:
        same = same & F.col(name).eqNullSafe(F.col(f"s_{name}"))
    if not pairs.where(~same).isEmpty():
        delete_path(spark, at)
        raise RuntimeError("the rewritten records differ from the source; nothing was committed")
    manifest = merge.join(result.select("file_id", "n_rows"), "file_id", "left").select("file_id", "folder", "file_path", "size_bytes", "n_records", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    manifest.write.mode("overwrite").parquet(f"{at}/manifest")
    retired = manifest.where("n_rows = n_records").select("folder", "file_path", F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("long").alias("n_records"), F.lit("delete").alias("op"), "file_id")
    files = stored.select("folder", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("size_bytes")).groupBy("folder", "file_path", "size_bytes").agg(F.count(F.lit(1)).alias("n_records"))
    retired.unionByName(files.withColumns({"op": F.lit("put"), "file_id": F.xxhash64("file_path")})).write.mode("overwrite").parquet(f"{at}/log")
    _replace_pointer(spark, target, version)
    _remove_others(spark, target, version)
    return committed(spark, target, "manifest")


def compact_store(log: DataFrame, tables: dict[str, DataFrame], target_bytes: int = TARGET_BYTES) -> dict[str, str]:
    """Compact the files of several record tables that share one log; the target folder of each table. The records of a file may lie in several tables: its rewritten rows are the sum over the manifests."""
    spark = log.sparkSession
    merge = materialize(plan_merge(log), "merge-plan")
    targets = {name: scratch_path(spark, f"compacted-{name}") for name in tables}
    for name, records in tables.items():
        compact(records, merge, targets[name], target_bytes)
    return targets


def merged_files(spark: SparkSession, targets: dict[str, str]) -> DataFrame:
    """(file_id, folder, size_bytes, n_records, n_rows, complete) of every file of the plan, over all tables: ``complete`` where the rewritten rows are as many as logged."""
    every = reduce(DataFrame.unionByName, [committed(spark, target, "manifest") for target in targets.values()])
    return every.groupBy("file_id", "folder", "size_bytes", "n_records").agg(F.sum("n_rows").alias("n_rows")).withColumn("complete", F.col("n_rows") == F.col("n_records"))
