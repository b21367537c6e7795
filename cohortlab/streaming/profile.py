"""A quality profile that grows with a stream: the states of each micro-batch are added to a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from cohortlab.operators.profiling import Suite, add_to_store


def profile_stream(rows: DataFrame, store: str, key: str, columns: Sequence[str], suite: Suite, row_key: str | None = None) -> DataStreamWriter:
    """A writer that adds the states of every micro-batch to ``store``, to be started with a checkpoint location. A batch that is run again replaces its own states, so every row counts once."""
    return rows.writeStream.foreachBatch(lambda batch, number: add_to_store(batch, store, key, columns, suite, row_key, batch=number))
