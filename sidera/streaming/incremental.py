"""Work that goes on where it stopped: keys done are skipped, failures are tried again, the latest record wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidera.sources.io import latest_by_key


def todo(items: DataFrame, log: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Items whose latest record in the log is missing or has an error."""
    done = latest_by_key(log, key, ordinal).where(F.col("error").isNull()).select(key)
    return items.join(done, key, "left_anti")


def results(items: DataFrame, log: DataFrame, key: str, ordinal: str, columns: list[str]) -> DataFrame:
    """items with the columns of their latest record; null where it is missing or an error."""
    latest = latest_by_key(log, key, ordinal)
    good = latest.where(F.col("error").isNull()).select(key, *columns)
    return items.join(good, key, "left")


def stream_results(records: DataFrame, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query that hands every micro-batch's records to the sink, all that is there, then stops.

    The sink gets the batch's number, so that a batch that comes again after a failure can be told.
    """
    return records.where(F.col(key).isNotNull()).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
