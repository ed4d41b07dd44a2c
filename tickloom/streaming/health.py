"""What running streams report about themselves, one row a micro-batch."""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

OBSERVED = "feed"
REPORT = "run string, batch long, rows long, first timestamp, newest timestamp, watermark timestamp, lag_s double, rows_per_s double, state_rows long, state_bytes long, dropped long"


def observed(stream: DataFrame, at: str = "time") -> DataFrame:
    """The stream, of which every batch tells its number of rows and their first and last time."""
    return stream.observe(OBSERVED, F.count(F.lit(1)).alias("rows"), F.min(at).alias("first"), F.max(at).alias("newest"))


class Health(StreamingQueryListener):
    """Takes down the progress of all streams between ``__enter__`` and ``__exit__``; a batch is reported once.

    ``lag_s``: how far the watermark stays behind the newest row. Figures are a few numbers a batch, kept on the driver
    until ``table`` writes them down.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self._ended = spark, {}, threading.Event()

    def __enter__(self) -> Health:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self._ended.wait(30)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self._ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(OBSERVED)
        mark = p.eventTime.get("watermark")
        mark = datetime.fromisoformat(mark.replace("Z", "+00:00")) if mark else None
        newest = seen["newest"].astimezone(mark.tzinfo) if seen and seen["newest"] and mark else None
        self.rows[p.runId, p.batchId] = (
            str(p.runId),
            p.batchId,
            seen["rows"] if seen else p.numInputRows,
            seen["first"] if seen else None,
            seen["newest"] if seen else None,
            mark,
            (newest - mark).total_seconds() if newest else None,
            float(p.inputRowsPerSecond or 0),
            sum(o.numRowsTotal for o in p.stateOperators),
            sum(o.memoryUsedBytes for o in p.stateOperators),
            sum(o.numRowsDroppedByWatermark for o in p.stateOperators),
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.set()

    def table(self) -> DataFrame:
        """One row for each batch that had rows or state."""
        return self.spark.createDataFrame(list(self.rows.values()), REPORT)
