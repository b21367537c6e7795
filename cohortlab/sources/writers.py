"""Sinks: Parquet data sets, split by ``set`` where there is one; CSV with header; NPZ archives."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an NPZ archive.
NPZ_ROWS = 1000


def write_dataset(df: DataFrame, path: str, by: str | None = "set", codec: str = "zstd") -> None:
    writer = df.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(by) if by and by in df.columns else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With header; blanks at the ends of texts are kept."""
    df.write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_npz(df: DataFrame, path: str, values: str, label: str, arrays: tuple[str, str] = ("images", "labels"), rows: int = NPZ_ROWS) -> int:
    """Archives of at most ``rows`` rows below ``path``, written by the executors; returns the number of rows written.

    Rows with a missing array, a missing label or an array of another length
    than the first of its archive cannot be in it and are left out. A retried
    task writes the same names again, so none is there twice.
    """
    first, second = arrays

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(inside, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        for whole in batches:
            for begin in range(0, len(whole), rows):
                frame = whole.iloc[begin : begin + rows]
                frame = frame[frame["values"].map(len) == len(frame["values"].iloc[0])]
                content = io.BytesIO()
                np.savez_compressed(content, **{first: np.stack(frame["values"].to_numpy()).astype(np.float32), second: frame["label"].to_numpy(np.int64)})
                with system.open_output_stream(f"{inside}/part-{part:05d}-{n:05d}.npz") as out:
                    out.write(content.getvalue())
                n += 1
                yield pd.DataFrame({"n": [len(frame)]})

    known = df.select(F.col(values).alias("values"), F.col(label).alias("label")).dropna()
    return known.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
