"""NPZ image sets as a data source of their own: ``spark.read.format("npz").load(path)`` after ``register(spark)``."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 256


class _Archive(InputPartition):
    def __init__(self, uri: str) -> None:
        self.uri = uri


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.arrays = options["path"], (options.get("values", "images"), options.get("label", "labels"))

    def partitions(self) -> list[InputPartition]:
        """One task per archive."""
        from pyarrow import fs

        system, inside = _system(self.path)
        info = system.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [_Archive(self.path)]
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inside)) if f.base_name.endswith(".npz"))
        return [_Archive(f"{self.path.rstrip('/')}/{name}") for name in names]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        system, inside = _system(partition.uri)
        with system.open_input_file(inside) as stream:
            content = io.BytesIO(stream.read())
        with np.load(content, allow_pickle=False) as archive:
            values, labels = (archive[name] for name in self.arrays)
        values = values.reshape(len(values), -1).astype(np.float32)
        for begin in range(0, len(values), ROWS):
            part = values[begin : begin + ROWS]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
            columns = [pa.array([partition.uri] * len(part)), pa.array(np.arange(begin, begin + len(part))), lists, pa.array(labels[begin : begin + len(part)].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "row", "values", "label"])


class NpzSource(DataSource):
    """Options: ``path`` of an archive or a folder of them, ``values`` and ``label``, the names of the arrays. Pickled members are refused."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "path string, row bigint, values array<float>, label bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)
