"""Streaming twins of the log and of the index: additions, as there is nothing that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.search import absorb


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last record of each key of a streamed log, tombstones included, for update or complete mode; the state is one row a key. ``living`` leaves the tombstones out when it is read."""
    cols = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(*key, "r.*")


def absorbed(segments: DataFrame, path: str, buckets: int = 64) -> DataStreamWriter:
    """A writer that adds streamed segments to an index, a batch under its own number: one that is replayed after a failure replaces itself."""
    return segments.writeStream.foreachBatch(lambda rows, no: absorb(rows, path, buckets, f"stream-{no}"))


def living(last: DataFrame, gone: Column) -> DataFrame:
    """What ``latest`` gives, without the keys whose last record is a tombstone."""
    return last.where(~F.coalesce(gone, F.lit(False)))


def windowed(events: DataFrame, at: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event-time window; what comes later than ``late`` is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n"))
