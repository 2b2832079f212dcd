"""Streams into series: each micro-batch is an insert, late rows included, and rollups follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.rollup import Rollup
from tidemark.sources.series import Series


def into_series(stream: DataFrame, series: Series, checkpoint: str, *, refresh: list[Rollup] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream's rows to a series; no watermark drops late rows, their buckets are made anew.

    A micro-batch that is retried after a failure is not inserted twice: its rows and its number become known in one
    change of the catalog, which remembers the last batch of each checkpoint.
    """

    def insert(rows: DataFrame, batch: int) -> None:
        series.insert(rows, batch=(checkpoint, batch))
        for r in refresh or []:
            r.refresh()

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
