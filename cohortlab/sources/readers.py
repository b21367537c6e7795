"""Sources: CSV, label lists, folder trees, pictures, NPZ archives."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.operators.labels import binary_label, stem
from cohortlab.session import hadoop_fs, materialize

FOLDERS = ("OTU_2d", "OTU_3d")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with header. Give the schema where it is known: inference reads the data twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def require_folder(spark: SparkSession, path: str) -> str:
    """The path, if there is a folder; an error that names it if not."""
    fs, at = hadoop_fs(spark, path)
    if not (fs.exists(at) and fs.getFileStatus(at).isDirectory()):
        raise FileNotFoundError(f"no such folder: {path}")
    return path


def label_fields(line: Column) -> tuple[Column, Column]:
    """File name and code of a blank-separated line; the code is null if it is no whole number."""
    parts = F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), r"\s+")
    code = F.get(parts, F.lit(1))
    return F.get(parts, F.lit(0)), F.when(code.rlike(r"\A[+-]?[0-9]{1,18}\z"), code).try_cast("long")


def parse_labels(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines → filename, original_label, binary_label, stem; blank lines fall away."""
    name, code = label_fields(F.col(line))
    return lines.where(F.col(line).rlike(r"\S")).withColumns({"filename": name, "original_label": code}).withColumns({"binary_label": binary_label(F.col("original_label")), "stem": stem(F.col("filename"))})


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return parse_labels(spark.read.text(path)).drop("value")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, suffix) of all files below a folder, empty ones included, names starting with _ or . not.

    Folders are listed level by level in the executors, a task per folder at
    most; no path passes through the driver. A missing folder is an error.
    """

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in batches:
            for parent in frame["path"]:
                system, inside = fs.FileSystem.from_uri(parent) if "://" in parent else (fs.LocalFileSystem(), parent)
                found = [f for f in system.get_file_info(fs.FileSelector(inside)) if not f.base_name.startswith(("_", "."))]
                yield pd.DataFrame({"path": [f"{parent.rstrip('/')}/{f.base_name}" for f in found], "is_folder": [f.type == fs.FileType.Directory for f in found]})

    files, level = None, spark.createDataFrame([(require_folder(spark, folder),)], "path string")
    while True:
        listed = materialize(level.mapInPandas(children, "path string, is_folder boolean"), "listing")
        here = listed.where(~F.col("is_folder")).select("path")
        files = here if files is None else files.unionByName(here)
        below = listed.where("is_folder").select("path")
        if below.isEmpty():
            break
        level = below.repartition("path")
    paths = files
    return paths.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1)))


def folder_counts(files: DataFrame, root: str, path: str = "path", majors: tuple[str, ...] = FOLDERS) -> DataFrame:
    """(major, folder, n) of files at least two levels below ``root``, with a row per major whose folder is null for the total. A file directly in a major folder counts under its own name."""
    below = F.substring_index(F.col(path), root, -1) if root else F.col(path)
    parts = F.split(F.regexp_replace(below, r"\A/+", ""), "/")
    placed = files.withColumn("_p", parts).where((F.size("_p") >= 2) & F.get("_p", F.lit(0)).isin(*majors))
    return placed.rollup(F.get("_p", F.lit(0)).alias("major"), F.get("_p", F.lit(1)).alias("folder")).agg(F.count(F.lit(1)).alias("n")).where("major is not null")


def suffix_counts(files: DataFrame) -> DataFrame:
    """(suffix, n)."""
    return files.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, pixels array<int> H,W,C in red, green, blue order); files that do not decode are left out, grey and four-channel pictures become three."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(require_folder(spark, folder))
    bands = images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("bands"), F.col("image.data").alias("data"))

    @F.pandas_udf("array<int>")
    def rgb(data: pd.Series, bands_: pd.Series) -> pd.Series:
        out = []
        for raw, n in zip(data, bands_):
            pixels = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
            pixels = np.repeat(pixels, 3, axis=1) if n == 1 else pixels[:, 2::-1]
            out.append(pixels.ravel().astype(np.int32))
        return pd.Series(out)

    return bands.withColumn("pixels", rgb("data", "bands")).drop("bands", "data")


def read_npz(spark: SparkSession, path: str, arrays: tuple[str, str] = ("images", "labels")) -> DataFrame:
    """(path, row, values array<float>, label long) of NPZ archives; pickled members are refused."""
    first, second = arrays

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name, content in zip(frame["path"], frame["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    values, labels = archive[first], archive[second]
                values = values.reshape(len(values), -1).astype(np.float32)
                for begin in range(0, len(values), 256):
                    part = values[begin : begin + 256]
                    yield pd.DataFrame({"path": name, "row": np.arange(begin, begin + len(part)), "values": list(part), "label": labels[begin : begin + len(part)].astype(np.int64)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, values array<float>, label long")
