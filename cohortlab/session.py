"""Session helpers: the shared folder and materialised intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that only matter where the session's owner has not chosen otherwise.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "cohortlab", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    for threads in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(threads, "1")  # a Python worker per core: matrix products must not start threads of their own
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``.

    Where it is unset and the master is local, a temporary folder is made and
    set; on a cluster an unset folder is an error, because no machine-local
    folder would survive the loss of an executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cohortlab-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_written: dict[str, set[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/cohortlab/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system and path objects of ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_path(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_fs(spark, path)
    fs.delete(at, True)


def folder_size(spark: SparkSession, path: str) -> int:
    fs, at = hadoop_fs(spark, path)
    return fs.getContentSummary(at).getLength()


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _written.pop(spark.sparkContext.applicationId, ()):
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may be gone already
            return


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut,
    executors may be lost, and later plans see the written size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """``materialize`` for large tables: the shuffle files of the step are removed once it is
    written, and the table is packed closer. Its folder may go to ``delete_path`` when nothing
    reads it any more."""
    spark = df.sparkSession
    path, setting = scratch_path(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path), path
